"""Further lint rules: conditions over nodes, measures of functions, and joins of names.

The tables have the form of those in ``lint``; ``check`` adds them to its findings.
"""

from __future__ import annotations

import builtins

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import lint
from quarry.sources import python_source as source

_DEF = "kind in ('FunctionDef','AsyncFunctionDef')"

#: (code, condition over nodes, message).
NODE_RULES = [
    ("A004", f"kind in ('Import','ImportFrom') and exists(split(a['names'], ','), x -> element_at(split(x, ' '), -1) in ('print','open','input','list','dict','set','str','int','float','bool','id','type','len','max','min','sum','map','filter','hash','iter','next','range','sorted','vars','zip'))", "import shadows a builtin"),
    ("ANN201", f"{_DEF} and a['returns'] is null and name not like '!_%' escape '!'", "missing return annotation"),
    ("ANN202", f"{_DEF} and a['returns'] is null and name like '!_%' escape '!' and name not like '!_!_%' escape '!'", "missing return annotation of a private function"),
    ("ANN204", f"{_DEF} and a['returns'] is null and name like '!_!_%!_!_' escape '!'", "missing return annotation of a special method"),
    ("ANN001", "kind = 'arg' and a['annotation'] is null and name not in ('self','cls')", "missing argument annotation"),
    ("ASYNC210", "kind = 'Call' and name rlike '^(requests|urllib[.]request)[.]' and in_async", "blocking request in an async function"),
    ("ASYNC230", "kind = 'Call' and name = 'open' and in_async", "blocking open in an async function"),
    ("ASYNC251", "kind = 'Call' and name = 'time.sleep' and in_async", "blocking sleep in an async function"),
    ("B017", "kind = 'Call' and name rlike '(^|[.])(assertRaises|raises)$' and a['arg0_src'] in ('Exception','BaseException')", "assertion of a blind exception"),
    ("B019", f"{_DEF} and a['decorators'] rlike '(^|,)(functools[.])?(lru_cache|cache)(,|$)' and parent_kind = 'ClassDef'", "cache on a method keeps instances alive"),
    ("B022", "kind = 'Call' and name = 'contextlib.suppress' and a['n_args'] is null", "suppress without exceptions"),
    ("B025", "kind = 'Try' and size(array_distinct(split(a['handler_types'], ','))) < size(split(a['handler_types'], ','))", "exception handled twice"),
    ("B026", "kind = 'Call' and a['star_after_keyword'] = '1'", "star after keyword"),
    ("B029", "kind = 'ExceptHandler' and a['type'] = 'Tuple' and a['n_elts'] is null and a['type_src'] = '()'", "handler of nothing"),
    ("B032", "kind = 'AnnAssign' and a['value'] is null and a['target'] = 'Attribute' and a['target_name'] not like 'self.%'", "annotation without assignment"),
    ("B034", "kind = 'Call' and name in ('re.sub','re.split','re.subn') and try_cast(a['n_args'] as int) > 3", "positional count or flags"),
    ("B905", "kind = 'Call' and name = 'zip' and try_cast(coalesce(a['n_args'], '0') as int) > 1 and a['kw'] not like '%strict%'", "zip without strict"),
    ("C404", "kind = 'Call' and name = 'dict' and a['arg0'] = 'ListComp'", "list comprehension in dict()"),
    ("C406", "kind = 'Call' and name = 'dict' and a['arg0'] in ('List','Tuple')", "literal in dict()"),
    ("C409", "kind = 'Call' and name = 'tuple' and a['arg0'] in ('List','Tuple')", "literal in tuple()"),
    ("C413", "kind = 'Call' and name in ('list','reversed') and a['arg0_src'] like 'sorted(%'", "call around sorted()"),
    ("C415", "kind = 'Call' and name in ('set','sorted','reversed') and a['arg0_src'] rlike '\\\\[::-1\\\\]$'", "reversal in an unordered call"),
    ("C416", "kind in ('ListComp','SetComp') and a['elt'] = 'Name' and a['n_generators'] = '1' and a['same'] = '1'", "comprehension that copies"),
    ("C418", "kind = 'Call' and name = 'dict' and a['arg0'] in ('Dict','DictComp')", "dict of a dict"),
    ("C419", "kind = 'Call' and name in ('any','all') and a['arg0'] = 'ListComp'", "list comprehension in any() or all()"),
    ("D102", f"{_DEF} and a['doc'] is null and parent_kind = 'ClassDef' and name not like '!_%' escape '!'", "method without docstring"),
    ("D105", f"{_DEF} and a['doc'] is null and parent_kind = 'ClassDef' and name rlike '^__.*__$' and name <> '__init__'", "special method without docstring"),
    ("D107", f"{_DEF} and a['doc'] is null and name = '__init__'", "__init__ without docstring"),
    ("D205", "kind in ('FunctionDef','ClassDef','Module') and a['doc'] rlike '^[^\\n]+\\n *[^ \\n]'", "no blank line after the summary"),
    ("D209", "kind in ('FunctionDef','ClassDef','Module') and a['doc'] like '%\\n%' and not a['doc'] rlike '\\n[ \\t]*$'", "closing quotes on a line of their own"),
    ("D402", f"{_DEF} and split(a['doc'], '\\n')[0] like concat(name, '(%')", "docstring repeats the signature"),
    ("D404", "kind in ('FunctionDef','ClassDef','Module') and a['doc'] rlike '^ *This\\\\b'", "docstring starts with This"),
    ("D415", "kind in ('FunctionDef','ClassDef','Module') and a['doc'] is not null and not split(trim(a['doc']), '\\n')[0] rlike '[.?!]$'", "first line ends in punctuation"),
    ("DTZ001", "kind = 'Call' and name = 'datetime.datetime' and a['kw'] not like '%tzinfo%' and try_cast(coalesce(a['n_args'], '0') as int) < 8", "datetime without zone"),
    ("DTZ003", "kind = 'Call' and name = 'datetime.datetime.utcnow'", "utcnow has no zone"),
    ("DTZ004", "kind = 'Call' and name = 'datetime.datetime.utcfromtimestamp'", "utcfromtimestamp has no zone"),
    ("DTZ005", "kind = 'Call' and name = 'datetime.datetime.now' and a['n_args'] is null and a['kw'] not like '%tz%'", "now without zone"),
    ("DTZ006", "kind = 'Call' and name = 'datetime.datetime.fromtimestamp' and coalesce(a['n_args'], '0') < '2' and a['kw'] not like '%tz%'", "fromtimestamp without zone"),
    ("DTZ011", "kind = 'Call' and name = 'datetime.date.today'", "today without zone"),
    ("EM102", "kind = 'Raise' and a['exc'] = 'Call' and a['src'] rlike '^[A-Za-z_.]+[(]f[\"\\']'", "f-string in exception"),
    ("EM103", "kind = 'Raise' and a['exc'] = 'Call' and a['src'] rlike '[.]format[(]'", "format in exception"),
    ("F502", "kind = 'BinOp' and a['op'] = 'Mod' and a['left'] = 'Constant' and a['left_value'] rlike '%[(]' and a['right'] in ('Tuple','List')", "mapping expected"),
    ("F702", "kind = 'Continue' and not in_loop", "continue outside a loop"),
    ("F701", "kind = 'Break' and not in_loop", "break outside a loop"),
    ("FLY002", "kind = 'Call' and a['func'] = 'Attribute' and a['arg0'] in ('List','Tuple') and a['join_literal'] = '1'", "join of a literal"),
    ("FURB105", "kind = 'Call' and name = 'print' and a['arg0_src'] in ('\\'\\'','\"\"') and a['n_args'] = '1'", "print of an empty text"),
    ("FURB129", "kind = 'Call' and name rlike '[.]readlines$' and field = 'iter'", "readlines in a loop"),
    ("FURB136", "kind = 'IfExp' and a['src'] rlike '^([a-z_]+) [<>]=? ([a-z_]+)$' and a['body'] = 'Name' and a['orelse'] = 'Name'", "use min or max"),
    ("FURB163", "kind = 'Call' and name = 'math.log' and a['arg1_src'] in ('2','10','math.e')", "use the log of this base"),
    ("FURB168", "kind = 'Call' and name = 'isinstance' and a['arg1_src'] = 'type(None)'", "use is None"),
    ("FURB187", "kind = 'Assign' and a['value_src'] rlike '^(reversed[(])?([a-z_]+)(\\\\[::-1\\\\]|[)])$' and a['target_names'] = regexp_extract(a['value_src'], '([a-z_]+)(\\\\[::-1\\\\]|[)])$', 1)", "use reverse()"),
    ("ICN001", "kind = 'Import' and a['names'] rlike '(^|,)(numpy|pandas|matplotlib.pyplot|tensorflow|seaborn|polars|networkx)( (?!np|pd|plt|tf|sns|pl|nx)[a-z_]+)?(,|$)'", "unconventional alias"),
    ("INT001", "kind = 'Call' and name in ('_','gettext','ngettext') and a['arg0'] = 'JoinedStr'", "f-string in a translation"),
    ("LOG001", "kind = 'Call' and name = 'logging.Logger'", "use getLogger"),
    ("LOG002", "kind = 'Call' and name = 'logging.getLogger' and a['arg0_src'] in ('__file__','__cached__')", "use __name__"),
    ("LOG009", "kind = 'Attribute' and name = 'WARN' and a['value_name'] = 'logging'", "WARN is not documented"),
    ("LOG015", "kind = 'Call' and name rlike '^logging[.](debug|info|warning|error|critical|exception|log)$'", "call on the root logger"),
    ("G001", "kind = 'Call' and name rlike '(^|[.])(log|logger|logging)[.](debug|info|warning|error|critical)$' and a['arg0_src'] rlike '[.]format[(]'", "format in a log call"),
    ("G002", "kind = 'Call' and name rlike '(^|[.])(log|logger|logging)[.](debug|info|warning|error|critical)$' and a['arg0'] = 'BinOp' and a['arg0_src'] like '% \\% %'", "percent format in a log call"),
    ("N804", f"{_DEF} and a['decorators'] rlike '(^|,)classmethod(,|$)' and split(a['params'], ',')[0] <> 'cls'", "first argument of a class method is cls"),
    ("N805", f"{_DEF} and parent_kind = 'ClassDef' and coalesce(a['decorators'], '') not rlike 'staticmethod|classmethod' and coalesce(a['params'], '') <> '' and split(a['params'], ',')[0] not in ('self','_','cls','mcs')", "first argument of a method is self"),
    ("N807", f"{_DEF} and func is null and name rlike '^__.*__$' and parent_kind = 'Module' and name not in ('__getattr__','__dir__')", "function name like a special method"),
    ("N818", "kind = 'ClassDef' and a['base_names'] rlike '(^|,)(Exception|.*Error)(,|$)' and not name rlike 'Error$'", "exception names end in Error"),
    ("NPY001", "kind = 'Attribute' and a['value_name'] in ('np','numpy') and name in ('bool','int','float','complex','object','str','long','unicode')", "alias removed from the library"),
    ("NPY002", "kind = 'Call' and name rlike '^numpy[.]random[.](rand|randn|randint|random|choice|shuffle|permutation|seed|normal|uniform)$'", "legacy random numbers"),
    ("PD002", "kind = 'Call' and a['kw_inplace'] = 'True'", "inplace has inconsistent effects"),
    ("PD011", "kind = 'Attribute' and name = 'values' and a['ctx'] = 'Load' and field not in ('func') and a['value'] in ('Name','Subscript') and a['value_name'] rlike '(^|_)df$'", "use to_numpy"),
    ("PIE800", "kind = 'Dict' and a['spread_empty'] = '1'", "needless spread"),
    ("PIE804", "kind = 'Call' and a['kw'] = '**' and a['spread_literal'] = '1'", "needless keyword dict"),
    ("PIE807", "kind = 'Lambda' and a['body'] in ('List','Dict') and a['n_params'] = '0' and a['empty_body'] = '1'", "use list or dict"),
    ("PIE808", "kind = 'Call' and name = 'range' and a['n_args'] = '2' and a['arg0_src'] = '0'", "needless start of range"),
    ("PLC0105", "kind = 'Call' and name in ('TypeVar','typing.TypeVar') and a['kw_covariant'] = 'True' and not a['arg0_src'] like '%_co\\''", "name does not tell the variance"),
    ("PLC0208", "kind in ('For','comprehension') and a['iter'] = 'Set'", "iteration over a set literal"),
    ("PLC1901", "kind = 'Compare' and a['right_src'] in ('\\'\\'','\"\"') and a['op'] in ('Eq','NotEq')", "comparison to an empty text"),
    ("PLC2401", "kind in ('Name','FunctionDef','ClassDef') and not name rlike '^[\\\\x00-\\\\x7F]*$'", "name that is not ASCII"),
    ("PLC3002", "kind = 'Call' and a['func'] = 'Lambda'", "lambda called at once"),
    ("PLE0100", f"kind in ('Yield','YieldFrom') and in_function = '__init__'", "yield in __init__"),
    ("PLE0101", "kind = 'Return' and a['src'] <> '' and a['src'] <> 'None' and in_function = '__init__'", "return of a value in __init__"),
    ("PLE0116", "kind = 'Continue' and field = 'finalbody'", "continue in finally"),
    ("PLE0117", "kind = 'Nonlocal' and func is null", "nonlocal at module level"),
    ("PLE0241", "kind = 'ClassDef' and a['base_names'] <> '' and size(array_distinct(filter(split(a['base_names'], ','), x -> x <> '?'))) < size(filter(split(a['base_names'], ','), x -> x <> '?'))", "base named twice"),
    ("PLE0604", "kind = 'Assign' and a['target_names'] = '__all__' and a['value_src'] rlike '[\\\\[(,] ?[0-9A-Za-z_]+[,\\\\])]'", "export that is not a text"),
    ("PLE0605", "kind = 'Assign' and a['target_names'] = '__all__' and a['value'] not in ('List','Tuple','BinOp','Call','Attribute','Name','ListComp')", "exports are no list"),
    ("PLE1142", "kind = 'Await' and not in_async", "await outside an async function"),
    ("PLE1205", "kind = 'Call' and name rlike '(^|[.])(log|logger|logging)[.](debug|info|warning|error|critical)$' and try_cast(coalesce(a['n_args'], '0') as int) > 1 and a['arg0'] = 'Constant' and not a['arg0_src'] like '%\\%%'", "too many arguments for the format"),
    ("PLE1507", "kind = 'Call' and name = 'os.getenv' and a['arg0'] = 'Constant' and not a['arg0_src'] rlike '^[\\'\"]'", "name of a variable is text"),
    ("PLR0133", "kind = 'Compare' and a['left'] = 'Constant' and a['right'] = 'Constant'", "two constants compared"),
    ("PLR0206", f"{_DEF} and a['decorators'] rlike '(^|,)property(,|$)' and try_cast(a['n_params'] as int) > 1", "property with parameters"),
    ("PLR1711", "kind = 'Return' and a['src'] in ('','None') and last_in_function", "needless return"),
    ("PLR5501", "kind = 'If' and a['orelse'] = 'If' and a['else_nested'] = '1'", "else around an if"),
    ("PLW0129", "kind = 'Assert' and a['test'] = 'Constant' and a['src'] rlike '^[\\'\"].+'", "assertion of a text"),
    ("PLW0131", "kind = 'NamedExpr' and parent_kind = 'Expr'", "named expression without use"),
    ("PLW0133", "kind = 'Expr' and a['value'] = 'Call' and a['call_name'] rlike '^(Exception|[A-Z][A-Za-z]*Error)$'", "exception made but not raised"),
    ("PLW0604", "kind = 'Global' and func is null", "global at module level"),
    ("PLW0711", "kind = 'ExceptHandler' and a['type'] = 'BoolOp'", "handler of a boolean operation"),
    ("PLW1501", "kind = 'Call' and name = 'open' and a['arg1_src'] rlike '^[\\'\"]' and not a['arg1_src'] rlike '^[\\'\"](U?[rwax]b?[+]?t?|U?[rwax][+]?b?t?)[\\'\"]$'", "bad open mode"),
    ("PLW1509", "kind = 'Call' and name = 'subprocess.Popen' and a['kw'] like '%preexec_fn%'", "preexec_fn is unsafe with threads"),
    ("PLW1510", "kind = 'Call' and name = 'subprocess.run' and a['kw'] not like '%check%'", "run without check"),
    ("PLW3301", "kind = 'Call' and name in ('min','max') and (a['arg0_src'] like concat(name, '(%') or a['arg1_src'] like concat(name, '(%'))", "nested min or max"),
    ("PT001", f"{_DEF} and a['decorator_calls'] rlike '(^|,)pytest[.]fixture[(][)](,|$)'", "needless parentheses on fixture"),
    ("PT009", "kind = 'Call' and name rlike '^self[.]assert(Equal|NotEqual|True|False|Is|IsNot|In|NotIn|Greater|Less)$'", "use a plain assert"),
    ("PT011", "kind = 'Call' and name = 'pytest.raises' and a['arg0_src'] in ('ValueError','OSError','IOError','EnvironmentError','socket.error','Exception') and a['kw'] not like '%match%'", "raises is too broad"),
    ("PT013", "kind = 'ImportFrom' and name = 'pytest'", "import pytest as a whole"),
    ("PTH101", "kind = 'Call' and name = 'os.chmod'", "use Path.chmod"),
    ("PTH102", "kind = 'Call' and name = 'os.mkdir'", "use Path.mkdir"),
    ("PTH103", "kind = 'Call' and name = 'os.makedirs'", "use Path.mkdir(parents=True)"),
    ("PTH104", "kind = 'Call' and name = 'os.rename'", "use Path.rename"),
    ("PTH105", "kind = 'Call' and name = 'os.replace'", "use Path.replace"),
    ("PTH106", "kind = 'Call' and name = 'os.rmdir'", "use Path.rmdir"),
    ("PTH107", "kind = 'Call' and name = 'os.remove'", "use Path.unlink"),
    ("PTH108", "kind = 'Call' and name = 'os.unlink'", "use Path.unlink"),
    ("PTH109", "kind = 'Call' and name = 'os.getcwd'", "use Path.cwd"),
    ("PTH111", "kind = 'Call' and name = 'os.path.expanduser'", "use Path.expanduser"),
    ("PTH112", "kind = 'Call' and name = 'os.path.isdir'", "use Path.is_dir"),
    ("PTH113", "kind = 'Call' and name = 'os.path.isfile'", "use Path.is_file"),
    ("PTH114", "kind = 'Call' and name = 'os.path.islink'", "use Path.is_symlink"),
    ("PTH115", "kind = 'Call' and name = 'os.readlink'", "use Path.readlink"),
    ("PTH116", "kind = 'Call' and name = 'os.stat'", "use Path.stat"),
    ("PTH117", "kind = 'Call' and name = 'os.path.isabs'", "use Path.is_absolute"),
    ("PTH119", "kind = 'Call' and name = 'os.path.basename'", "use Path.name"),
    ("PTH120", "kind = 'Call' and name = 'os.path.dirname'", "use Path.parent"),
    ("PTH121", "kind = 'Call' and name = 'os.path.samefile'", "use Path.samefile"),
    ("PTH122", "kind = 'Call' and name = 'os.path.splitext'", "use Path.suffix"),
    ("PTH202", "kind = 'Call' and name = 'os.path.getsize'", "use Path.stat().st_size"),
    ("PTH204", "kind = 'Call' and name = 'os.path.getmtime'", "use Path.stat().st_mtime"),
    ("PTH207", "kind = 'Call' and name in ('glob.glob','glob.iglob')", "use Path.glob"),
    ("PTH208", "kind = 'Call' and name = 'os.listdir'", "use Path.iterdir"),
    ("RET505", "kind = 'If' and a['body'] rlike 'Return$' and a['orelse'] is not null", "needless else after return"),
    ("RET506", "kind = 'If' and a['body'] rlike 'Raise$' and a['orelse'] is not null", "needless else after raise"),
    ("RET507", "kind = 'If' and a['body'] rlike 'Continue$' and a['orelse'] is not null", "needless else after continue"),
    ("RET508", "kind = 'If' and a['body'] rlike 'Break$' and a['orelse'] is not null", "needless else after break"),
    ("RUF005", "kind = 'BinOp' and a['op'] = 'Add' and (a['left'] = 'List' or a['right'] = 'List')", "concatenation of lists"),
    ("RUF010", "kind = 'FormattedValue' and a['value'] = 'Call' and a['call_name'] in ('str','repr','ascii')", "conversion call in an f-string"),
    ("RUF012", "kind = 'Assign' and parent_kind = 'ClassDef' and a['value'] in ('List','Dict','Set','ListComp','DictComp','SetComp') and a['target_names'] not in ('__slots__','__all__','_fields_')", "mutable class attribute"),
    ("RUF015", "kind = 'Subscript' and a['slice_value'] = '0' and a['call_name'] = 'list'", "first element through a list"),
    ("RUF018", "kind = 'Assert' and a['src'] like '%:=%'", "assignment in an assertion"),
    ("RUF024", "kind = 'Call' and name = 'dict.fromkeys' and a['arg1'] in ('List','Dict','Set')", "shared mutable value"),
    ("RUF030", "kind = 'Assert' and a['msg'] = 'Call' and a['msg_call'] = 'print'", "print as message"),
    ("S106", "kind = 'keyword' and lower(name) rlike '(pass(word|wd)?|secret|token)$' and a['value'] = 'Constant' and a['value_value'] rlike '^[\\'\"].+'", "hard-coded password argument"),
    ("S202", "kind = 'Call' and name rlike '[.]extractall$'", "extraction of all members"),
    ("S306", "kind = 'Call' and name = 'tempfile.mktemp'", "unsafe temporary name"),
    ("S308", "kind = 'Call' and name rlike '(^|[.])mark_safe$'", "unescaped text"),
    ("S310", "kind = 'Call' and name in ('urllib.request.urlopen','urllib.request.urlretrieve')", "any scheme is opened"),
    ("S312", "kind = 'Call' and name = 'telnetlib.Telnet'", "unencrypted protocol"),
    ("S313", "kind = 'Call' and name rlike '^xml[.]etree[.](cElementTree)[.](parse|fromstring|iterparse)$'", "unsafe parsing"),
    ("S314", "kind = 'Call' and name rlike '^xml[.]etree[.]ElementTree[.](parse|fromstring|iterparse|XMLParser)$'", "unsafe parsing"),
    ("S318", "kind = 'Call' and name rlike '^xml[.]dom[.]minidom[.](parse|parseString)$'", "unsafe parsing"),
    ("S321", "kind = 'Call' and name rlike '^ftplib[.]'", "unencrypted protocol"),
    ("S323", "kind = 'Call' and name = 'ssl._create_unverified_context'", "certificates are not checked"),
    ("S401", "kind in ('Import','ImportFrom') and (name = 'telnetlib' or a['names'] rlike '(^|,)telnetlib( |,|$)')", "import of telnetlib"),
    ("S402", "kind in ('Import','ImportFrom') and (name = 'ftplib' or a['names'] rlike '(^|,)ftplib( |,|$)')", "import of ftplib"),
    ("S403", "kind in ('Import','ImportFrom') and (name in ('pickle','dill','shelve') or a['names'] rlike '(^|,)(pickle|cPickle|dill|shelve)( |,|$)')", "import of pickle"),
    ("S404", "kind in ('Import','ImportFrom') and (name = 'subprocess' or a['names'] rlike '(^|,)subprocess( |,|$)')", "import of subprocess"),
    ("S502", "kind = 'Call' and name = 'ssl.wrap_socket' and a['kw_ssl_version'] rlike 'SSLv2|SSLv3|TLSv1$'", "insecure protocol version"),
    ("S504", "kind = 'Call' and name = 'ssl.wrap_socket' and a['kw'] not like '%ssl_version%'", "no protocol version"),
    ("S507", "kind = 'Call' and name rlike 'set_missing_host_key_policy$' and a['arg0_src'] rlike 'AutoAddPolicy|WarningPolicy'", "host keys are not checked"),
    ("S508", "kind = 'Call' and name = 'pysnmp.hlapi.CommunityData' and a['kw_mpModel'] in ('0','1')", "insecure protocol version"),
    ("S603", "kind = 'Call' and name rlike '^subprocess[.](run|call|check_call|check_output|Popen)$' and coalesce(a['kw_shell'], 'False') = 'False' and a['arg0'] not in ('Constant','List')", "subprocess with untrusted input"),
    ("S606", "kind = 'Call' and name rlike '^os[.](execl|execle|execlp|execv|execve|execvp|spawnl|spawnv|startfile)$'", "process without a shell"),
    ("S607", "kind = 'Call' and name rlike '^subprocess[.]' and a['arg0_src'] rlike '^\\\\[?[\\'\"][a-z][A-Za-z0-9_-]*[\\'\" ]'", "partial path of an executable"),
    ("S609", "kind = 'Call' and name rlike '^(os[.](system|popen)|subprocess[.].*)$' and a['arg0_src'] rlike '(chown|chmod|tar|rsync).*[*]'", "wildcard in a command"),
    ("S610", "kind = 'Call' and name rlike '[.]objects[.](filter[.])?extra$'", "raw query parts"),
    ("S611", "kind = 'Call' and name rlike '(^|[.])RawSQL$'", "raw query"),
    ("S702", "kind = 'Call' and name = 'mako.template.Template'", "templates without escaping"),
    ("SIM107", "kind = 'Return' and field = 'finalbody'", "return in finally"),
    ("SIM112", "kind = 'Call' and name in ('os.environ.get','os.getenv') and a['arg0_src'] rlike '[a-z]' and a['arg0'] = 'Constant'", "environment names are upper case"),
    ("SIM202", "kind = 'UnaryOp' and a['op'] = 'Not' and a['src'] rlike ' != ' and a['operand'] = 'Compare'", "use =="),
    ("SIM208", "kind = 'UnaryOp' and a['op'] = 'Not' and a['src'] like 'not %' and a['operand'] = 'UnaryOp'", "double negation"),
    ("SIM211", "kind = 'IfExp' and a['body_value'] = 'False' and a['orelse_value'] = 'True'", "use not"),
    ("SIM220", "kind = 'BoolOp' and a['op'] = 'And' and a['parts'] rlike '^([a-z_]+) ; not \\\\1$'", "always false"),
    ("SIM221", "kind = 'BoolOp' and a['op'] = 'Or' and a['parts'] rlike '^([a-z_]+) ; not \\\\1$'", "always true"),
    ("SIM222", "kind = 'BoolOp' and a['op'] = 'Or' and a['parts'] rlike '(^|; )True($| ;)'", "always true"),
    ("SIM223", "kind = 'BoolOp' and a['op'] = 'And' and a['parts'] rlike '(^|; )False($| ;)'", "always false"),
    ("SIM300", "kind = 'Compare' and a['left'] = 'Constant' and a['right'] in ('Name','Attribute') and a['op'] in ('Eq','NotEq','Lt','LtE','Gt','GtE')", "constant on the left"),
    ("SIM905", "kind = 'Call' and a['func'] = 'Attribute' and a['split_literal'] = '1'", "split of a literal"),
    ("SIM910", "kind = 'Call' and name rlike '[.]get$' and a['arg1_src'] = 'None'", "None is the default"),
    ("SLF001", "kind = 'Attribute' and name rlike '^_[^_]' and not a['value_name'] in ('self','cls','mcs')", "private member used"),
    ("TID252", "kind = 'ImportFrom' and try_cast(coalesce(a['level'], '0') as int) > 1", "relative import from a parent"),
    ("TRY003", "kind = 'Raise' and a['exc'] = 'Call' and length(a['src']) > 80 and a['src'] rlike '[(]f?[\"\\']'", "long message in a raise"),
    ("TRY004", "kind = 'Raise' and a['src'] rlike '^(Exception|ValueError|RuntimeError)' and parent_test like 'not isinstance%'", "use TypeError"),
    ("TRY203", "kind = 'ExceptHandler' and a['body'] = 'Raise' and a['reraise'] = '1'", "handler that only raises again"),
    ("TRY300", "kind = 'Return' and field = 'body' and parent_kind = 'Try' and siblings > 1", "return in try belongs in else"),
    ("UP003", "kind = 'Call' and name = 'type' and a['n_args'] = '1' and a['arg0'] = 'Constant'", "type of a literal"),
    ("UP005", "kind = 'Attribute' and name in ('assertEquals','assertNotEquals','assertAlmostEquals','assertRegexpMatches','assertRaisesRegexp','failUnless','failIf','assert_')", "old name of an assertion"),
    ("UP006", "kind = 'Subscript' and a['value_name'] rlike '^(typing[.])?(List|Dict|Set|FrozenSet|Tuple|Type|Deque|DefaultDict)$'", "use the builtin generic"),
    ("UP007", "kind = 'Subscript' and a['value_name'] rlike '^(typing[.])?(Union|Optional)$'", "use | for unions"),
    ("UP010", "kind = 'ImportFrom' and name = '__future__' and not a['names'] like '%annotations%'", "needless future import"),
    ("UP011", f"kind in ('FunctionDef','AsyncFunctionDef') and a['decorator_calls'] rlike '(^|,)(functools[.])?lru_cache[(][)](,|$)'", "needless parentheses on lru_cache"),
    ("UP021", "kind = 'keyword' and name = 'universal_newlines'", "use text"),
    ("UP022", "kind = 'Call' and name = 'subprocess.run' and a['kw_stdout'] = 'subprocess.PIPE' and a['kw_stderr'] = 'subprocess.PIPE'", "use capture_output"),
    ("UP024", "kind = 'Name' and name in ('EnvironmentError','IOError','WindowsError') and a['ctx'] = 'Load'", "alias of OSError"),
    ("UP026", "kind = 'Import' and a['names'] rlike '(^|,)mock( |,|$)'", "use unittest.mock"),
    ("UP028", "kind = 'For' and a['body'] = 'Expr' and a['yields_target'] = '1'", "use yield from"),
    ("UP033", f"kind in ('FunctionDef','AsyncFunctionDef') and a['decorator_calls'] rlike 'lru_cache[(]maxsize=None[)]'", "use cache"),
    ("UP035", "kind = 'ImportFrom' and name = 'typing' and a['names'] rlike '(^|,)(List|Dict|Set|Tuple|Type|FrozenSet|Text|Callable|Iterable|Iterator|Sequence|Mapping)( |,|$)'", "deprecated import"),
    ("UP036", "kind = 'If' and a['src'] rlike '^sys[.]version_info (<|>=?) [(]3, [0-9][)]'", "outdated version block"),
    ("YTT101", "kind = 'Subscript' and a['value_name'] = 'sys.version'", "sys.version is text"),
    ("YTT201", "kind = 'Compare' and a['left_src'] = 'sys.version_info[0]' and a['right_src'] = '3' and a['op'] = 'Eq'", "use >="),
]
#: What counts as a branch or a statement of a function.
BRANCHES = ["If", "For", "AsyncFor", "While", "ExceptHandler", "With", "IfExp", "BoolOp", "comprehension", "match_case"]
STATEMENTS = ["Assign", "AugAssign", "AnnAssign", "Expr", "Return", "Delete", "If", "For", "While", "With", "Try", "Raise", "Assert", "Import", "ImportFrom", "Pass", "Break", "Continue"]
#: (code, measure, limit, message).
LIMITS = [("C901", "complexity", 10, "is too complex"), ("PLR0911", "returns", 6, "has too many returns"), ("PLR0912", "branches", 12, "has too many branches"), ("PLR0915", "statements", 50, "has too many statements")]


def measures(nodes: DataFrame) -> DataFrame:
    """(path, func, name, row, returns, branches, statements, complexity) per function; nested functions count for themselves."""
    inner = nodes.filter("func is not null").groupBy("path", "func").agg(
        F.count_if(F.col("kind") == "Return").alias("returns"),
        F.count_if(F.col("kind").isin("If", "For", "While", "ExceptHandler", "match_case")).alias("branches"),
        F.count_if(F.col("kind").isin(STATEMENTS)).alias("statements"),
        (1 + F.count_if(F.col("kind").isin(BRANCHES))).alias("complexity"),
    )
    functions = nodes.filter("kind in ('FunctionDef', 'AsyncFunctionDef')").select("path", F.col("node").alias("func"), "name", "row")
    return functions.join(inner, ["path", "func"], "left").fillna(0)


def over_limits(nodes: DataFrame) -> DataFrame:
    hits = F.array(*[F.when(F.col(m) > limit, F.struct(F.lit(code).alias("code"), F.concat("name", F.lit(f" {says}")).alias("message"))) for code, m, limit, says in LIMITS])
    return measures(nodes).select("path", "row", F.lit(0).alias("col"), F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("r")).select("path", "row", "col", "r.*")


def _finding(df: DataFrame, code: str, says: str) -> DataFrame:
    return df.select("path", "row", F.lit(0).alias("col"), F.lit(code).alias("code"), F.concat("name", F.lit(f" {says}")).alias("message"))


def unused_arguments(nodes: DataFrame) -> DataFrame:
    """Arguments that neither their function nor one inside it reads; stubs and overrides by decorator are left out."""
    args = nodes.filter("kind = 'arg' and name not in ('self', 'cls') and name not like '!_%' escape '!'").select("path", "scope", "name", "row")
    stubs = nodes.filter("kind in ('FunctionDef', 'AsyncFunctionDef') and (attrs['body'] in ('Pass', 'Expr', 'Raise') or attrs['decorators'] rlike 'overload|override|abstractmethod')").select("path", F.col("node").alias("scope"))
    used = source.references(nodes).join(lint._scope_chain(nodes), ["path", "scope"]).select("path", F.col("at").alias("scope"), "name").distinct()
    return _finding(args.join(used, ["path", "scope", "name"], "left_anti").join(stubs, ["path", "scope"], "left_anti"), "ARG001", "is never used")


def shadowed_builtins(nodes: DataFrame) -> DataFrame:
    """Bindings that hide a builtin: variables A001, arguments A002."""
    found = source.bindings(nodes).filter(F.col("name").isin([n for n in dir(builtins) if not n.startswith("_")]) & F.col("kind").isin("assignment", "argument", "FunctionDef", "ClassDef"))
    code = F.when(F.col("kind") == "argument", "A002").otherwise("A001")
    return found.select("path", "row", F.lit(0).alias("col"), code.alias("code"), F.concat("name", F.lit(" hides a builtin")).alias("message"))


def undefined_exports(nodes: DataFrame) -> DataFrame:
    """Names in ``__all__`` that the module does not bind."""
    lists = nodes.filter("kind = 'Assign' and attrs['target_names'] = '__all__'").select("path", F.col("node").alias("assign"))
    values = nodes.filter("kind in ('List', 'Tuple')").select("path", F.col("node").alias("values"), F.col("parent").alias("assign"))
    names = nodes.filter("kind = 'Constant' and attrs['type'] = 'str'").select("path", F.col("parent").alias("values"), F.expr("substring(value, 2, length(value) - 2)").alias("name"), "row")
    exported = names.join(values, ["path", "values"]).join(lists, ["path", "assign"])
    bound = source.bindings(nodes).filter("scope = 0").select("path", "name").distinct()
    stars = source.imports(nodes).filter("name = '*'").select("path").distinct()
    return _finding(exported.join(bound, ["path", "name"], "left_anti").join(stars, "path", "left_anti"), "F822", "is exported but undefined")


def unused_loop_variables(nodes: DataFrame) -> DataFrame:
    """Loop variables that nothing in their scope reads."""
    loops = nodes.filter("kind = 'For'").select("path", F.col("node").alias("parent"))
    targets = nodes.filter("kind = 'Name' and field = 'target' and name not like '!_%' escape '!'").join(loops, ["path", "parent"]).select("path", "scope", "name", "row")
    used = source.references(nodes).join(lint._scope_chain(nodes), ["path", "scope"]).select("path", F.col("at").alias("scope"), "name").distinct()
    return _finding(targets.join(used, ["path", "scope", "name"], "left_anti"), "B007", "is not used in its loop")


def repeated_methods(nodes: DataFrame) -> DataFrame:
    """Fields that a class defines twice."""
    stores = nodes.filter("kind = 'Name' and attrs['ctx'] = 'Store'").select("path", "scope", "name", "row")
    classes = nodes.filter("kind = 'ClassDef'").select("path", F.col("node").alias("scope"))
    twice = stores.join(classes, ["path", "scope"]).groupBy("path", "scope", "name").agg(F.count(F.lit(1)).alias("n"), F.max("row").alias("row"))
    return _finding(twice.filter("n > 1"), "PIE794", "is defined twice")


JOINS = {"C901": over_limits, "ARG001": unused_arguments, "A001": shadowed_builtins, "F822": undefined_exports, "B007": unused_loop_variables, "PIE794": repeated_methods}

#: The codes they give.
JOINED = {*JOINS, "A002", *(code for code, *_ in LIMITS)}


def joined(nodes: DataFrame, enabled: set[str] | None = None) -> DataFrame:
    """(path, row, col, code, message) of the rules that join or aggregate nodes."""
    found = nodes.selectExpr("path", "row", "col", "'' as code", "'' as message").limit(0)
    for code, rule in JOINS.items():
        codes = {"C901": {c for c, *_ in LIMITS}, "A001": {"A001", "A002"}}.get(code, {code})
        if enabled is None or enabled & codes:
            own = rule(nodes)
            found = found.unionByName(own if enabled is None else own.filter(F.col("code").isin(sorted(enabled))))
    return found


def check(nodes: DataFrame, enabled: set[str] | None = None) -> DataFrame:
    """(path, row, col, code, message) of these rules."""
    return lint.check_nodes(nodes, enabled, NODE_RULES).unionByName(joined(nodes, enabled))
