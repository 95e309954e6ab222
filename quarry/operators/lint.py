"""Lint rules as conditions over relations.

A rule is a code, the relation it reads, an SQL condition and a message. All rules of a relation are evaluated in one pass
over it: each row yields the rules that hold, so more rules make no more scans. Rules that relate rows (unused,
undefined, redefined names) are joins of their own.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import lines as text_lines
from quarry.operators.rel import spread, written
from quarry.sources import python_source as source

#: (code, condition over nodes, message). a is the node's attribute map.
NODE_RULES = [
    ("E701", "kind in ('If','For','While','With','Try','FunctionDef','ClassDef') and row = end_row", "statement on the line of its head"),
    ("E711", "kind = 'Compare' and a['op'] in ('Eq','NotEq') and (a['right_src'] = 'None' or a['left_src'] = 'None')", "comparison to None"),
    ("E712", "kind = 'Compare' and a['op'] in ('Eq','NotEq') and (a['right_src'] in ('True','False') or a['left_src'] in ('True','False'))", "comparison to a truth value"),
    ("E713", "kind = 'UnaryOp' and a['op'] = 'Not' and a['operand'] = 'Compare' and a['src'] like '% in %' and a['src'] not like '% not in %'", "test for membership is `not in`"),
    ("E714", "kind = 'UnaryOp' and a['op'] = 'Not' and a['operand'] = 'Compare' and a['src'] like '% is %' and a['src'] not like '% is not %'", "test for identity is `is not`"),
    ("E721", "kind = 'Compare' and a['op'] in ('Eq','NotEq','Is','IsNot') and a['left_src'] like 'type(%)'", "types are compared by isinstance"),
    ("E722", "kind = 'ExceptHandler' and a['type'] is null", "bare except"),
    ("E731", "kind = 'Assign' and a['value'] = 'Lambda' and a['targets'] = 'Name'", "lambda bound to a name"),
    ("E741", "kind in ('Name','arg','ExceptHandler','Global','Nonlocal','alias') and (name in ('l','O','I') and (kind <> 'Name' or a['ctx'] = 'Store') or a['asname'] in ('l','O','I') or a['names_src'] rlike '(^|,)[lOI](,|$)')", "ambiguous variable name"),
    ("E742", "kind = 'ClassDef' and name in ('l','O','I')", "ambiguous class name"),
    ("E743", "kind in ('FunctionDef','AsyncFunctionDef') and name in ('l','O','I')", "ambiguous function name"),
    ("F403", "kind = 'ImportFrom' and a['names'] = '*'", "star import"),
    ("F541", "kind = 'JoinedStr' and a['placeholders'] = '0'", "f-string without placeholder"),
    ("F601", "kind in ('Dict') and a['repeated'] <> ''", "repeated dictionary key"),
    ("F631", "kind = 'Assert' and a['test'] = 'Tuple'", "assertion on a tuple"),
    ("F632", "kind = 'Compare' and a['op'] in ('Is','IsNot') and (a['right_src'] rlike '^[0-9\"\\']' or a['left_src'] rlike '^[0-9\"\\']')", "identity with a literal"),
    ("F634", "kind in ('If','IfExp') and a['test'] = 'Tuple'", "condition on a tuple"),
    ("F706", "kind = 'Return' and func is null", "return outside a function"),
    ("F704", "kind in ('Yield','YieldFrom','Await') and func is null", "yield outside a function"),
    ("F901", "kind = 'Raise' and (a['exc_name'] = 'NotImplemented' or a['src'] like 'NotImplemented(%')", "raise NotImplementedError"),
    ("B002", "kind = 'UnaryOp' and a['op'] = 'UAdd' and a['operand'] = 'UnaryOp'", "there is no increment operator"),
    ("B003", "kind = 'Assign' and a['target_names'] = 'os.environ'", "assigning to os.environ does not clear the environment"),
    ("B004", "kind = 'Call' and name in ('hasattr','getattr') and a['arg1_src'] = '\\'__call__\\''", "callable() tests for calls"),
    ("B005", "kind = 'Call' and name rlike '[.](strip|lstrip|rstrip)$' and a['arg0'] = 'Constant' and a['arg0_src'] rlike '^[\\'\"].*(.).*\\\\1.*[\\'\"]$'", "strip takes a set of characters, and one stands twice"),
    ("B006", "kind in ('FunctionDef','AsyncFunctionDef','Lambda') and (a['defaults'] rlike '(^|,)(List|Dict|Set|ListComp|DictComp|SetComp)(,|$)' or a['default_calls'] rlike '(^|,)(list|dict|set|defaultdict|deque|collections[.](defaultdict|deque|OrderedDict|Counter))(,|$)')", "mutable default"),
    ("B008", "kind in ('FunctionDef','AsyncFunctionDef') and a['default_calls'] <> '' and not a['default_calls'] rlike '(^|,)(list|dict|set|tuple|frozenset|MappingProxyType|types.MappingProxyType|operator[.].*)(,|$)'", "call in a default"),
    ("B009", "kind = 'Call' and name = 'getattr' and a['n_args'] = '2' and a['arg1'] = 'Constant' and a['arg1_src'] rlike '^\\'[A-Za-z_]+\\'$'", "getattr with a constant"),
    ("B010", "kind = 'Call' and name = 'setattr' and a['arg1'] = 'Constant' and a['arg1_src'] rlike '^\\'[A-Za-z_]+\\'$'", "setattr with a constant"),
    ("B011", "kind = 'Assert' and a['src'] = 'False'", "assert False goes away when optimised"),
    ("B012", "kind in ('Return','Break','Continue') and field = 'finalbody'", "leaving from finally"),
    ("B013", "kind = 'ExceptHandler' and a['type'] = 'Tuple' and a['n_elts'] = '1'", "tuple of one exception"),
    ("B015", "kind = 'Expr' and a['value'] = 'Compare'", "comparison without use"),
    ("B016", "kind = 'Raise' and a['exc'] = 'Constant'", "a literal is raised"),
    ("B018", "kind = 'Expr' and a['value'] in ('Name','List','Set','Dict','Tuple','BinOp','UnaryOp','Attribute')", "expression without use"),
    ("B024", "kind = 'ClassDef' and a['base_names'] rlike '(^|,)(abc[.])?ABC(,|$)' and a['body'] not like '%FunctionDef%'", "abstract class without methods"),
    ("B028", "kind = 'Call' and name = 'warnings.warn' and a['kw'] not like '%stacklevel%'", "warning without stacklevel"),
    ("B033", "kind = 'Set' and a['repeated'] <> ''", "repeated set item"),
    ("B904", "kind = 'Raise' and a['cause'] is null and a['exc'] = 'Call' and in_handler", "raise in a handler without from"),
    ("BLE001", "kind = 'ExceptHandler' and a['type_name'] in ('Exception','BaseException')", "blind except"),
    ("C400", "kind = 'Call' and name = 'list' and a['arg0'] = 'GeneratorExp'", "generator in list()"),
    ("C401", "kind = 'Call' and name = 'set' and a['arg0'] = 'GeneratorExp'", "generator in set()"),
    ("C402", "kind = 'Call' and name = 'dict' and a['arg0'] = 'GeneratorExp'", "generator in dict()"),
    ("C403", "kind = 'Call' and name = 'set' and a['arg0'] = 'ListComp'", "list comprehension in set()"),
    ("C405", "kind = 'Call' and name = 'set' and a['arg0'] in ('List','Tuple')", "literal in set()"),
    ("C408", "kind = 'Call' and name in ('dict','list','tuple') and a['n_args'] is null and a['kw'] = ''", "call for an empty literal"),
    ("C410", "kind = 'Call' and name = 'list' and a['arg0'] in ('List','Tuple')", "literal in list()"),
    ("C411", "kind = 'Call' and name = 'list' and a['arg0'] = 'ListComp'", "list comprehension in list()"),
    ("C414", "kind = 'Call' and name in ('list','set','sorted','tuple') and a['arg0'] = 'Call' and a['arg0_src'] rlike '^(list|tuple|sorted|set|reversed)[(]'", "call inside a call that undoes it"),
    ("C417", "kind = 'Call' and name = 'map' and a['arg0'] = 'Lambda'", "map with lambda"),
    ("D100", "kind = 'Module' and a['doc'] is null", "module without docstring"),
    ("D101", "kind = 'ClassDef' and a['doc'] is null and name not like '!_%' escape '!'", "class without docstring"),
    ("D103", "kind in ('FunctionDef','AsyncFunctionDef') and a['doc'] is null and name not like '!_%' escape '!'", "function without docstring"),
    ("D200", "kind in ('FunctionDef','ClassDef','Module') and a['doc'] rlike '^\\\\s*\\n[^\\n]*\\n\\\\s*$'", "docstring of one line over several"),
    ("D210", "kind in ('FunctionDef','ClassDef','Module') and (a['doc'] like ' %' or a['doc'] rlike '[^\\n ] +$')", "blanks around docstring"),
    ("D400", "kind in ('FunctionDef','ClassDef','Module') and a['doc'] is not null and not split(trim(a['doc']), '\\n')[0] rlike '[.]$'", "first line ends in a period"),
    ("D403", "kind in ('FunctionDef','ClassDef') and a['doc'] rlike '^[a-z]+ '", "first word is capitalised"),
    ("D419", "kind in ('FunctionDef','ClassDef','Module') and trim(a['doc']) = ''", "empty docstring"),
    ("EM101", "kind = 'Raise' and a['exc'] = 'Call' and a['src'] rlike '^[A-Za-z_.]+[(][\"\\']'", "string literal in exception"),
    ("FBT003", "kind = 'Call' and (a['arg0_src'] in ('True','False') or a['arg1_src'] in ('True','False')) and not coalesce(name, '') rlike '(^|[.])(set|get|setattr|getattr|assert.*|append|print)$'", "truth value by position"),
    ("G004", "kind = 'Call' and name rlike '(^|[.])(log|logger|logging)[.](debug|info|warning|error|critical|exception)$' and a['arg0'] = 'JoinedStr'", "f-string in a log call"),
    ("G010", "kind = 'Call' and name rlike '(^|[.])(log|logger|logging)[.]warn$'", "warn is deprecated"),
    ("N801", "kind = 'ClassDef' and not name rlike '^_*[A-Z][A-Za-z0-9]*_*$'", "class names are in CapWords"),
    ("N802", "kind in ('FunctionDef','AsyncFunctionDef') and name rlike '[A-Z]' and not name rlike '^(setUp|tearDown|visit_)'", "function names are lower case"),
    ("N803", "kind = 'arg' and name rlike '[A-Z]'", "argument names are lower case"),
    ("N806", "kind = 'Name' and a['ctx'] = 'Store' and func is not null and name rlike '[A-Z]' and name rlike '[a-z]'", "variable names are lower case"),
    ("PIE790", "kind = 'Pass' and field = 'body' and siblings > 1", "needless pass"),
    ("PIE810", "kind = 'BoolOp' and a['op'] = 'Or' and a['parts'] rlike '^([A-Za-z_.]+)[.](starts|ends)with[(].*; \\\\1[.]\\\\2with[(]'", "one call takes several prefixes"),
    ("PLC0414", "kind in ('Import','ImportFrom') and a['names'] rlike '(^|,)([A-Za-z_]+) \\\\2(,|$)'", "alias equals name"),
    ("PLR0124", "kind = 'Compare' and a['left_src'] = a['right_src'] and a['n_ops'] = '1'", "compared with itself"),
    ("PLR0402", "kind = 'Import' and a['names'] rlike '[.]([A-Za-z_]+) \\\\1(,|$)'", "use from import"),
    ("PLR0913", "kind in ('FunctionDef','AsyncFunctionDef') and try_cast(a['n_params'] as int) > 5", "more than 5 parameters"),
    ("PLR1714", "kind = 'BoolOp' and a['op'] = 'Or' and a['parts'] rlike '^([A-Za-z_.]+) == .* ; \\\\1 == '", "membership says it shorter"),
    ("PLR1722", "kind = 'Call' and name in ('exit','quit')", "use sys.exit"),
    ("PLR2004", "kind = 'Compare' and a['right'] = 'Constant' and a['right_src'] rlike '^-?[0-9.]+$' and not a['right_src'] in ('0','1','0.0','1.0')", "magic value"),
    ("PLW0120", "kind in ('For','While') and a['orelse'] is not null and a['body'] not like '%Break%' and not a['body'] rlike 'If|Try|With|For|While'", "else on a loop without break"),
    ("PLW0127", "kind = 'Assign' and a['targets'] = 'Name' and a['value'] = 'Name' and a['target_names'] = a['value_src']", "assigned to itself"),
    ("PLW1508", "kind = 'Call' and name = 'os.getenv' and a['arg1'] = 'Constant' and not a['arg1_src'] rlike '^[\\'\"N]'", "default of getenv is text"),
    ("PT015", "kind = 'Assert' and a['src'] in ('False','0','None','\\'\\'')", "assertion always fails"),
    ("PT018", "kind = 'Assert' and a['test'] = 'BoolOp' and a['src'] like '% and %'", "assertion of several parts"),
    ("PTH100", "kind = 'Call' and name = 'os.path.abspath'", "use Path.resolve"),
    ("PTH110", "kind = 'Call' and name = 'os.path.exists'", "use Path.exists"),
    ("PTH118", "kind = 'Call' and name = 'os.path.join'", "use the / of Path"),
    ("PTH123", "kind = 'Call' and name = 'open'", "use Path.open"),
    ("RET501", "kind = 'Return' and a['value_value'] = 'None'", "explicit return None"),
    ("RSE102", "kind = 'Raise' and a['exc'] = 'Call' and a['src'] rlike '^[A-Za-z_.]+[(][)]$'", "needless parentheses on raise"),
    ("S101", "kind = 'Assert'", "assert"),
    ("S102", "kind = 'Call' and name = 'exec'", "exec"),
    ("S103", "kind = 'Call' and name = 'os.chmod' and a['arg1_src'] in ('511','0o777','438')", "permissive mode"),
    ("S104", "kind = 'Constant' and value = '\\'0.0.0.0\\''", "all interfaces"),
    ("S105", "kind = 'Assign' and lower(a['target_names']) rlike '(pass(word|wd)?|secret|token)$' and a['value'] = 'Constant' and length(a['value_src']) > 2 and a['value_src'] rlike '^[\\'\"]'", "hard-coded password"),
    ("S108", "kind = 'Constant' and value rlike '^\\'/(tmp|var/tmp|dev/shm)/'", "temporary file by name"),
    ("S110", "kind = 'ExceptHandler' and a['body'] = 'Pass'", "exception passed over"),
    ("S112", "kind = 'ExceptHandler' and a['body'] = 'Continue'", "exception continued over"),
    ("S113", "kind = 'Call' and name rlike '^(requests|httpx)[.](get|post|put|delete|patch|head|options|request)$' and (a['kw'] not like '%timeout%' or a['kw_timeout'] = 'None')", "request without timeout"),
    ("S301", "kind = 'Call' and name in ('pickle.load','pickle.loads','marshal.load','marshal.loads','dill.load','dill.loads','shelve.open')", "unsafe deserialisation"),
    ("S307", "kind = 'Call' and name = 'eval'", "eval"),
    ("S311", "kind = 'Call' and name rlike '^random[.](random|randrange|randint|choice|choices|uniform|triangular|Random)$'", "random numbers are not secret"),
    ("S324", "kind = 'Call' and name in ('hashlib.md5','hashlib.sha1','hashlib.md4') and coalesce(a['kw_usedforsecurity'], '') <> 'False'", "weak hash"),
    ("S501", "kind = 'Call' and name rlike '^(requests|httpx)[.]' and a['kw_verify'] = 'False'", "certificates are not checked"),
    ("S506", "kind = 'Call' and name = 'yaml.load' and not coalesce(a['kw_Loader'], a['arg1_src'], '') rlike 'SafeLoader|CSafeLoader'", "unsafe yaml load"),
    ("S602", "kind = 'Call' and name rlike '^subprocess[.](run|call|check_call|check_output|Popen)$' and a['kw_shell'] = 'True'", "subprocess with a shell"),
    ("S605", "kind = 'Call' and name in ('os.system','os.popen')", "process with a shell"),
    ("S608", "kind in ('JoinedStr','BinOp') and text_sql", "query built from text"),
    ("S701", "kind = 'Call' and name rlike '(^|[.])Environment$' and name like 'jinja2%' and coalesce(a['kw_autoescape'], 'False') = 'False'", "templates without escaping"),
    ("SIM101", "kind = 'BoolOp' and a['op'] = 'Or' and a['parts'] rlike '^isinstance[(]([A-Za-z_.]+),.*; isinstance[(]\\\\1,'", "one isinstance takes several"),
    ("SIM102", "kind = 'If' and a['body'] = 'If' and a['orelse'] is null", "nested conditions"),
    ("SIM103", "kind = 'If' and a['body'] = 'Return' and a['orelse'] = 'Return'", "returns a condition"),
    ("SIM105", "kind = 'Try' and a['n_handlers'] = '1' and a['handler_body'] = 'Pass' and a['n_body'] = '1' and a['orelse'] is null and a['finalbody'] is null", "suppress says it"),
    ("SIM108", "kind = 'If' and a['body'] = 'Assign' and a['orelse'] = 'Assign'", "conditional expression"),
    ("SIM115", "kind = 'Call' and name = 'open' and field <> 'context_expr' and parent_kind <> 'withitem'", "open without with"),
    ("SIM117", "kind = 'With' and a['body'] = 'With'", "nested with"),
    ("SIM118", "kind = 'Compare' and a['op'] in ('In','NotIn') and a['right_src'] like '%.keys()'", "needless keys()"),
    ("SIM201", "kind = 'UnaryOp' and a['op'] = 'Not' and a['src'] rlike ' == ' and a['operand'] = 'Compare'", "use !="),
    ("SIM210", "kind = 'IfExp' and a['body_value'] = 'True' and a['orelse_value'] = 'False'", "use bool()"),
    ("T201", "kind = 'Call' and name = 'print'", "print"),
    ("T203", "kind = 'Call' and name = 'pprint.pprint'", "pprint"),
    ("T100", "kind = 'Call' and name in ('breakpoint','pdb.set_trace','ipdb.set_trace')", "debugger"),
    ("TRY002", "kind = 'Raise' and a['src'] rlike '^(Exception|BaseException)([(]|$)'", "a plain exception is raised"),
    ("TRY201", "kind = 'Raise' and in_handler and a['exc'] = 'Name' and a['src'] = handler_name", "raise without the name"),
    ("TRY400", "kind = 'Call' and name rlike '(^|[.])(log|logger|logging)[.]error$' and in_handler", "use exception()"),
    ("UP004", "kind = 'ClassDef' and a['base_names'] rlike '(^|,)object(,|$)'", "object as base"),
    ("UP008", "kind = 'Call' and name = 'super' and a['n_args'] = '2'", "super() takes no arguments"),
    ("UP015", "kind = 'Call' and name = 'open' and a['arg1_src'] in ('\\'r\\'','\\'rt\\'')", "needless open mode"),
    ("UP018", "kind = 'Call' and name in ('str','bytes','int','float','bool') and a['arg0'] = 'Constant' and a['n_args'] = '1' and a['kw'] = '' and ((name = 'str' and a['arg0_src'] like '\\'%') or (name = 'int' and a['arg0_src'] rlike '^[0-9]+$'))", "call on a literal of the type"),
    ("UP032", "kind = 'Attribute' and name = 'format' and a['value'] = 'Constant' and field = 'func'", "use an f-string"),
    ("E999", "kind = 'SyntaxError'", "syntax error"),
]
#: (code, condition over lines, message).
LINE_RULES = [
    ("E501", "length(line) > 88 and size(split(trim(line), ' +')) > 1 and not element_at(split(trim(line), ' +'), -1) like '%://%'", "line too long"),
    ("E101", "line rlike '^ +\\t|^\\t+ '", "tabs and spaces in one indent"),
    ("W191", "line rlike '^\\t'", "tab in indent"),
    ("W291", "line rlike '[^ \\t][ \\t]+$'", "trailing blanks"),
    ("W293", "line rlike '^[ \\t]+$'", "blanks on an empty line"),
    ("W292", "last and line <> ''", "no line feed at the end"),
    ("PLE2502", f"line rlike '{text_lines.BIDI}'", "direction changed inside text"),
    ("PLE2515", "line rlike '\\u200b'", "zero width space"),
    ("FIX001", "line rlike '#.*\\\\bFIXME\\\\b'", "FIXME"),
    ("FIX002", "line rlike '#.*\\\\bTODO\\\\b'", "TODO"),
    ("FIX003", "line rlike '#.*\\\\bXXX\\\\b'", "XXX"),
    ("FIX004", "line rlike '#.*\\\\bHACK\\\\b'", "HACK"),
    ("TD002", "line rlike '# *TODO' and not line rlike '# *TODO *[(]'", "TODO without author"),
    ("PGH003", "line rlike '# type: *ignore *($|[^\\\\[ ])'", "type: ignore without rules"),
    ("PGH004", "line rlike '(?i)# noqa *($|[^:])'", "noqa without rules"),
    ("E265", "line rlike '^ *#[^ !:#]'", "comment starts with a blank"),
    ("RUF003", f"line rlike '#.*[{''.join(text_lines.CONFUSABLE)}]'", "ambiguous character in a comment"),
]
#: (code, condition over successive tokens, message); p and n are the tokens before and after.
TOKEN_RULES = [
    ("E703", "kind = 'SEMI' and n_kind in ('NEWLINE','COMMENT')", "needless semicolon"),
    ("E702", "kind = 'SEMI' and n_kind not in ('NEWLINE','COMMENT')", "several statements on a line"),
    ("E201", "kind in ('LPAR','LSQB','LBRACE') and n_row = end_row and n_col > end_col and n_kind not in ('COMMENT','NL','NEWLINE')", "blank after an opening bracket"),
    ("E202", "kind in ('RPAR','RSQB','RBRACE') and p_end_row = row and p_end_col < col and p_kind not in ('COMMA','NL','INDENT','DEDENT')", "blank before a closing bracket"),
    ("E203", "kind in ('COMMA','SEMI') and p_end_row = row and p_end_col < col", "blank before punctuation"),
    ("E211", "kind in ('LPAR','LSQB') and p_kind = 'NAME' and p_end_row = row and p_end_col < col and not p_text rlike '^(and|as|assert|await|case|del|elif|else|except|for|from|if|import|in|is|lambda|match|not|or|print|raise|return|while|with|yield)$'", "blank before a bracket"),
    ("E231", "kind = 'COMMA' and n_row = end_row and n_col = end_col and n_kind not in ('RPAR','RSQB','NEWLINE','NL','COMMENT')", "no blank after a comma"),
    ("E261", "kind = 'COMMENT' and p_end_row = row and p_kind not in ('NL','NEWLINE','INDENT','DEDENT') and col - p_end_col < 2", "two blanks before a comment"),
    ("W605", "kind = 'STRING' and not text rlike '^[a-zA-Z]*[rR]' and text rlike '(^|[^\\\\\\\\])(\\\\\\\\\\\\\\\\)*\\\\\\\\[^\\\\n\\\\\\\\\\'\"abfnrtv0-7xNuU]'", "invalid escape"),
    ("Q000", "kind = 'STRING' and text rlike '^\\'[^\\'\"]*\\'$'", "double quotes preferred"),
    ("COM818", "kind = 'COMMA' and n_kind = 'NEWLINE'", "a trailing comma makes a tuple"),
    ("ISC001", "kind = 'STRING' and n_kind = 'STRING' and n_row = end_row", "strings joined without operator"),
]


_QUOTED = re.compile(r"'(?:[^'\\]|\\.)*'", re.S)
_KINDS = re.compile(r"kind (?:= '(\w+)'|in \(([^)]*)\))(?: and (.*))?", re.S)


def _hits(rules: list[tuple[str, str, str]]) -> str:
    each = ", ".join(f"if({condition}, struct('{code}' as code, '{message}' as message), null)" for code, condition, message in rules)
    return f"filter(array({each}), x -> x is not null)"


def _rules(table: list[tuple[str, str, str]], enabled: set[str] | None):
    """The rules that hold for a row, or None where none is enabled.

    Rules that name the kinds of rows they read are tried on rows of these kinds alone.
    """
    chosen = [r for r in table if enabled is None or r[0] in enabled]
    by_kind: dict[str, list[tuple[str, str, str]]] = {}
    rest = []
    for code, condition, message in chosen:
        told = _KINDS.fullmatch(condition)
        if not told:
            rest.append((code, condition, message))
            continue
        for kind in [told[1]] if told[1] else re.findall(r"'(\w+)'", told[2]):
            by_kind.setdefault(kind, []).append((code, f"({told[3]})" if told[3] else "true", message))
    if not chosen:
        return None
    none = "cast(array() as array<struct<code:string,message:string>>)"
    cases = " ".join(f"when '{kind}' then {_hits(rules)}" for kind, rules in by_kind.items())
    found = f"case kind {cases} else {none} end" if cases else none
    return F.explode(F.expr(f"concat({found}, {_hits(rest)})" if rest else found))


def read_by(table: list[tuple[str, str, str]], enabled: set[str]) -> dict[str, set[str]]:
    """Kinds, attributes and columns of nodes that the enabled rules of a table read, as their conditions name them."""
    conditions = [condition for code, condition, _ in table if code in enabled]
    told = [_KINDS.fullmatch(condition) for condition in conditions]
    kinds = {k for t in told if t for k in ([t[1]] if t[1] else re.findall(r"'(\w+)'", t[2]))}
    bare = " ".join(_QUOTED.sub("''", c) for c in conditions)
    attrs = {k for c in conditions for k in re.findall(r"\ba\['(\w+)'\]", c)} | ({"constants"} if "text_sql" in bare else set())
    columns = {"path", "row", "col", "kind", "name", "attrs"} | set(re.findall(r"\w+", bare)) | ({"full"} if "Call" in kinds or not all(told) else set())
    return {"attrs": attrs, "columns": columns} | ({"kinds": kinds} if all(told) else {})


def check_nodes(nodes: DataFrame, enabled: set[str] | None = None, table: list[tuple[str, str, str]] = NODE_RULES) -> DataFrame:
    """(path, row, col, code, message) of rules over nodes, one narrow pass: a node's row tells where it stands."""
    rules = _rules(table, enabled)
    if rules is None:
        return nodes.selectExpr("path", "row", "col", "'' as code", "'' as message").limit(0)
    named = F.when(F.col("kind") == "Call", F.col("full")).otherwise(F.col("name")) if "full" in nodes.columns else F.col("name")
    ready = nodes.withColumn("bare", F.col("name")).withColumn("name", named).withColumn("a", F.col("attrs"))
    ready = ready.withColumn("text_sql", F.coalesce(F.col("a")["constants"].rlike(text_lines.SQL_TEXT), F.lit(False)))
    return ready.select("path", F.coalesce("row", F.lit(1)).alias("row"), F.coalesce("col", F.lit(0)).alias("col"), rules.alias("r")).select("path", "row", "col", "r.*")


def check_lines(files: DataFrame, enabled: set[str] | None = None, table: list[tuple[str, str, str]] = LINE_RULES) -> DataFrame:
    rules = _rules(table, enabled)
    found = text_lines.lines(files if rules is None else spread(files.select("path", "text")))
    if rules is None:
        return found.selectExpr("path", "line_no as row", "0 as col", "'' as code", "'' as message").limit(0)
    return found.select("path", F.col("line_no").alias("row"), F.lit(0).alias("col"), rules.alias("r")).select("path", "row", "col", "r.*")


def check_tokens(tokens: DataFrame, enabled: set[str] | None = None, table: list[tuple[str, str, str]] = TOKEN_RULES) -> DataFrame:
    """Rules over each token and its neighbours, one narrow pass."""
    rules = _rules(table, enabled)
    if rules is None:
        return tokens.selectExpr("path", "row", "col", "'' as code", "'' as message").limit(0)
    return tokens.select("path", "row", "col", rules.alias("r")).select("path", "row", "col", "r.*")


def exported_names(nodes: DataFrame) -> DataFrame:
    """(path, bound): names that statements on __all__ list."""
    text = F.col("attrs")["exports"]
    lists = nodes.filter("kind in ('Assign', 'AnnAssign', 'AugAssign', 'Expr') and attrs['exports'] rlike '^__all__( =| [+]=|:|[.](extend|append)[(])'")
    return lists.select("path", F.explode(F.regexp_extract_all(text, F.lit("['\"]([^'\"]+)['\"]"), F.lit(1))).alias("bound"))


def unused_imports(nodes: DataFrame) -> DataFrame:
    """Imported names that no scope which sees the import reads, that no annotation in quotes names, and that the module does not export.

    All sides grow with the files, whatever the planner takes them for by the bytes read, so that none goes through the driver to be broadcast.
    """
    used = source.references(nodes).join(_scope_chain(nodes).hint("merge"), ["path", "scope"]).select("path", F.col("at").alias("scope"), F.col("name").alias("bound"))
    quoted = nodes.filter("kind = 'Constant' and field in ('annotation', 'returns', 'slice') and attrs['type'] = 'str'")
    # Quoted names and exports are taken for uses of the import wherever it stands in the file.
    named = quoted.select("path", F.explode(F.regexp_extract_all("value", F.lit(r"[^\W\d]\w*"), F.lit(0))).alias("bound")).unionByName(exported_names(nodes))
    found = source.imports(nodes).filter("coalesce(name, '') <> '*' and module <> '__future__' and coalesce(asname, '') <> coalesce(name, module)")
    # A name that a function declares global is one of the module's.
    lifted = _declared(nodes).filter("kind = 'Global'").select("path", "scope", F.col("name").alias("bound"), F.lit(True).alias("_lifted"))
    placed = found.join(lifted.distinct().hint("merge"), ["path", "scope", "bound"], "left").withColumn("scope", F.when(F.col("_lifted"), F.lit(0)).otherwise(F.col("scope")))
    unused = placed.join(used.distinct().hint("merge"), ["path", "scope", "bound"], "left_anti").join(named.distinct().hint("merge"), ["path", "bound"], "left_anti")
    return unused.select("path", "row", F.lit(0).alias("col"), F.lit("F401").alias("code"), F.concat("bound", F.lit(" imported but unused")).alias("message"))


def redefined(nodes: DataFrame) -> DataFrame:
    """Functions and classes of one name in one scope with no use between."""
    defined = nodes.filter("kind in ('FunctionDef', 'AsyncFunctionDef', 'ClassDef') and coalesce(attrs['decorators'], '') = '' and field = 'body'")
    window = Window.partitionBy("path", "scope", "parent", "name").orderBy("row", "node")
    pairs = defined.withColumn("before", F.lag("row").over(window)).filter("before is not null").select("path", "scope", "name", "row", "before")
    used = source.references(nodes).select("path", "name", F.col("row").alias("used"))
    between = pairs.join(used, ["path", "name"]).filter("used > before and used < row").select("path", "scope", "name", "row").distinct()
    kept = pairs.join(between, ["path", "scope", "name", "row"], "left_anti")
    return kept.select("path", "row", F.lit(0).alias("col"), F.lit("F811").alias("code"), F.concat(F.lit("redefinition of "), "name").alias("message"))


def _scope_chain(nodes: DataFrame) -> DataFrame:
    """(path, scope, at): every scope with itself and the scopes around it, at any depth; a class's names are not seen from inside its functions."""
    scopes = nodes.filter("around is not null")
    return scopes.select("path", F.col("node").alias("scope"), F.explode(F.split("around", ",").cast("array<int>")).alias("at"))


def _declared(nodes: DataFrame) -> DataFrame:
    """(path, scope, name, kind): names of global and nonlocal statements."""
    found = nodes.filter("kind in ('Global', 'Nonlocal')")
    names = F.split(F.regexp_replace(F.col("attrs")["names_src"], " ", ""), ",")
    return found.select("path", "scope", F.explode(names).alias("name"), "kind")


def undefined_names(nodes: DataFrame, builtins: list[str] | None = None, stars: bool = False) -> DataFrame:
    """Names read that no scope around binds and that are no builtins, in files without star imports; with ``stars`` in files with them.

    A name that a scope declares global is bound in the module by what the scope assigns to it.
    """
    import builtins as python

    known = builtins or [*dir(python), "__file__", "__name__", "__doc__", "__path__", "__package__", "__spec__", "__loader__", "__class__", "__builtins__", "__annotations__", "__module__", "__qualname__", "WindowsError"]
    open_ = source.imports(nodes).filter("name = '*'").select("path").distinct()
    bound = source.bindings(nodes).select("path", F.col("scope").alias("at"), "name").distinct()
    elsewhere = _declared(nodes).filter("kind = 'Global'").select("path", F.col("scope").alias("at"), "name").distinct()
    lifted = bound.join(elsewhere, ["path", "at", "name"], "left_semi").select("path", F.lit(0).alias("at"), "name")
    visible = _scope_chain(nodes).join(bound.unionByName(lifted).distinct(), ["path", "at"]).select("path", "scope", "name").distinct()
    missing = source.references(nodes).filter(~F.col("name").isin(known)).join(visible, ["path", "scope", "name"], "left_anti")
    missing = missing.join(open_, "path", "left_semi" if stars else "left_anti")
    return missing.select("path", "row", "col", "name", F.lit("F821").alias("code"), F.concat(F.lit("undefined name "), "name").alias("message"))


def unused_variables(nodes: DataFrame) -> DataFrame:
    """Assignments, also annotated ones and those of ``with``, in functions to names that the function and those inside it never read."""
    local = nodes.filter("kind = 'Name' and attrs['ctx'] = 'Store' and func is not null and func = scope and not name rlike '^_'")
    valued = nodes.filter("kind = 'AnnAssign' and attrs['value'] is not null").select("path", F.col("node").alias("parent"))
    annotated = local.filter("field = 'target' and parent_kind = 'AnnAssign'").join(valued, ["path", "parent"], "left_semi").select(local.columns)
    stores = local.filter("field in ('targets', 'optional_vars')").unionByName(annotated)
    uses = source.references(nodes).join(_scope_chain(nodes), ["path", "scope"]).select("path", F.col("at").alias("scope"), "name").distinct()
    unused = stores.join(uses, ["path", "scope", "name"], "left_anti").join(_declared(nodes).select("path", "scope", "name").distinct(), ["path", "scope", "name"], "left_anti")
    return unused.select("path", "row", "col", F.lit("F841").alias("code"), F.concat("name", F.lit(" is assigned but never used")).alias("message"))


def unsorted_imports(nodes: DataFrame) -> DataFrame:
    """Module-level imports that sort before the one above them in the same run of imports."""
    top = nodes.filter("kind in ('Import', 'ImportFrom') and parent = 0")
    key = F.struct(F.coalesce(F.col("name"), F.split(F.split(F.col("attrs")["names"], ",")[0], " ")[0]).alias("module"), F.col("attrs")["names"].alias("names"))
    window = Window.partitionBy("path").orderBy("row", "node")
    marked = top.withColumn("key", key).withColumn("above", F.lag("key").over(window)).withColumn("above_end", F.lag("end_row").over(window)).withColumn("above_kind", F.lag("kind").over(window))
    found = marked.filter("above_end = row - 1 and above_kind = kind and lower(above.module) > lower(key.module)")
    return found.select("path", "row", "col", F.lit("I001").alias("code"), F.lit("imports are not sorted").alias("message"))


def suppressions(tokens: DataFrame) -> DataFrame:
    """(path, row, codes): noqa comments; ``codes`` null where all are meant."""
    found = tokens.filter("kind = 'COMMENT' and text rlike '(?i)# *noqa'")
    codes = F.regexp_extract("text", r"(?i)# *noqa *: *([A-Z]+[0-9]+(?:[ ,]+[A-Z]+[0-9]+)*)", 1)
    return found.select("path", "row", F.when(codes != "", F.split(codes, "[ ,]+")).alias("codes"))


def suppressed(found: DataFrame, noqa: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings that remain, suppressions that nothing used)."""
    by = noqa.select("path", "row", "codes")
    # A row's comments as one, so that every finding is read once.
    whole = by.groupBy("path", "row").agg(F.bool_or(F.col("codes").isNull()).alias("_all"), F.flatten(F.collect_list("codes")).alias("_codes"))
    marked = found.join(whole, ["path", "row"], "left").withColumn("_silent", F.coalesce(F.col("_all") | F.array_contains("_codes", F.col("code")), F.lit(False)))
    unused = by.join(marked.filter("_silent").select("path", "row").distinct(), ["path", "row"], "left_anti")
    return marked.filter("not _silent").select(found.columns), unused


#: Rules that join nodes by names, and what of the nodes they read. Those that are not named here read everything.
_NAMES = {"kinds": source.NAMED | {"Global", "Nonlocal", "Assign", "AnnAssign", "AugAssign", "Expr", "Constant", "List", "Tuple"}, "attrs": {"ctx", "rest", "names", "level", "names_src", "exports", "type", "value", "decorators", "target_names"}}
_PLACED = set("path node parent scope func field kind row col name value attrs parent_kind around".split())
JOINED = {
    **dict.fromkeys(("F401", "F402", "F405", "F811", "F821", "F822", "F841", "F842"), _NAMES),
    **dict.fromkeys(("FA100", "FA102"), {"kinds": {"Import", "ImportFrom", "Subscript", "BinOp"}, "attrs": {"names", "level", "value_name", "op"}}),
    "PLE0115": {"kinds": {"Global", "Nonlocal"}, "attrs": {"names_src"}},
}


def parsed(files: DataFrame, enabled: set[str] | None, table: list[tuple[str, str, str]], joins: set[str]) -> DataFrame:
    """The nodes that the enabled rules read. Written only where rules join them, which read them again; conditions are one pass that needs no copy."""
    own = joins if enabled is None else joins & enabled
    if enabled is None or own - JOINED.keys():
        return written(source.nodes(files)) if own else source.nodes(files)
    asked = read_by(table, enabled)
    if not own:
        return source.nodes(files, **asked)
    for code in own:
        asked = {k: v | JOINED[code].get(k, _PLACED) for k, v in asked.items()}
    return written(source.nodes(files, **asked))


def check(files: DataFrame, enabled: set[str] | None = None) -> DataFrame:
    """All findings of files (path, text): rules by relation, joins between relations, less the suppressed ones."""
    from quarry.operators import lint_files, lint_more, lint_rules

    rules = [*NODE_RULES, *lint_more.NODE_RULES, *lint_rules.NODE_RULES]
    joins = {"F401": unused_imports, "F811": redefined, "F821": undefined_names, "F841": unused_variables, "I001": unsorted_imports}
    nodes, tokens = parsed(files, enabled, rules, {*joins, *lint_more.JOINED, *lint_files.JOINED}), source.tokens(files)
    # A file whose text has no such word has no such comment.
    comments = source.tokens(files.filter(F.lower("text").contains("noqa")))
    if enabled is None or enabled & {code for code, *_ in [*TOKEN_RULES, *lint_rules.TOKEN_RULES]}:
        tokens = comments = written(tokens)
    found = check_nodes(nodes, enabled, rules)
    found = found.unionByName(check_lines(files, enabled, [*LINE_RULES, *lint_rules.LINE_RULES])).unionByName(check_tokens(tokens, enabled, [*TOKEN_RULES, *lint_rules.TOKEN_RULES]))
    for code, rule in joins.items():
        if enabled is None or code in enabled:
            found = found.unionByName(rule(nodes).select(*found.columns))
    found = found.unionByName(lint_more.joined(nodes, enabled)).unionByName(lint_files.check(files, nodes, tokens, enabled))
    return suppressed(found, suppressions(comments))[0]


def statistics(found: DataFrame) -> DataFrame:
    """Findings by code and the number of files they are in."""
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("n_files"))


RULES = {code: message for table in (NODE_RULES, LINE_RULES, TOKEN_RULES) for code, _, message in table}
