"""Lint rules whose condition reads a node's own source and its place: a table in the form of those in ``lint``."""

from __future__ import annotations

import types

_DEF = "kind in ('FunctionDef','AsyncFunctionDef')"
_STUB = "path like '%.pyi'"
_NAME = "[A-Za-z_][A-Za-z0-9_.]*"
#: Special methods of Python's own types and those that only classes of users define.
DUNDERS = sorted(
    {m for t in (object, int, float, complex, str, bytes, list, dict, set, type, property, types.ModuleType, types.GeneratorType, types.CoroutineType) for m in dir(t) if m.startswith("__")}
    | set("__del__ __bytes__ __bool__ __complex__ __length_hint__ __missing__ __enter__ __exit__ __aenter__ __aexit__ __aiter__ __anext__ __getattr__ __prepare__ __init_subclass__ __set_name__ __class_getitem__".split())
    | set("__copy__ __deepcopy__ __post_init__ __fspath__ __matmul__ __rmatmul__ __imatmul__ __iadd__ __isub__ __imul__ __itruediv__ __ifloordiv__ __imod__ __ipow__ __ilshift__ __irshift__ __iand__ __ixor__ __ior__ __html__ __match_args__ __slots__".split())
)
_LOG = "coalesce(a['on'], '') rlike '(^|[.])(log|logger|logging|LOG|LOGGER)$'"
_ONE, _TWO = "'__str__','__repr__','__len__','__bool__','__hash__','__iter__','__next__','__enter__','__bytes__','__index__','__int__','__float__','__neg__','__aiter__','__anext__'", "'__eq__','__ne__','__lt__','__le__','__gt__','__ge__','__getitem__','__delitem__','__contains__','__add__','__sub__','__mul__','__and__','__or__','__xor__','__getattr__','__format__'"
_METHOD = f"{_DEF} and parent_kind = 'ClassDef' and not coalesce(a['decorators'], '') rlike 'staticmethod|classmethod'"


def _returns(method: str, right: str) -> str:
    """A literal returned by a special method that is not of the type it owes."""
    return f"kind = 'Return' and in_class is not null and in_function = '{method}' and a['value'] in ('Constant','JoinedStr','List','Dict','Tuple','Set') and not {right}"


#: (code, condition over nodes, message).
NODE_RULES = [
    ("F404", "kind = 'ImportFrom' and name = '__future__' and exists(split(before, ','), k -> k not in ('', 'Doc', 'ImportFrom'))", "future import after other statements"),
    ("F407", "kind = 'alias' and parent_kind = 'ImportFrom' and parent_name = '__future__' and name not in ('annotations','division','absolute_import','print_function','unicode_literals','generators','nested_scopes','with_statement','generator_stop','barry_as_FLUFL')", "unknown future feature"),
    ("F406", "kind = 'ImportFrom' and a['names'] = '*' and parent_kind <> 'Module'", "star import inside a block"),
    ("F622", "kind in ('Tuple','List') and a['ctx'] = 'Store' and a['elts'] rlike 'Starred.*Starred'", "two stars in an assignment"),
    ("F633", "kind = 'BinOp' and a['op'] = 'RShift' and a['left_name'] = 'print'", "print as a statement"),
    ("F707", "kind = 'ExceptHandler' and a['type'] is null and position < siblings - 1", "bare except before others"),
    ("F722", "kind in ('arg','AnnAssign','FunctionDef','AsyncFunctionDef') and a['bad_annotation'] = '1'", "annotation is no expression"),
    ("E401", "kind = 'Import' and try_cast(a['n_names'] as int) > 1", "several imports on a line"),
    ("E402", "kind in ('Import','ImportFrom') and parent_kind = 'Module' and exists(split(before, ','), k -> k not in ('','Doc','Dunder','Import','ImportFrom','If','Try'))", "import below code"),
    ("PLC0131", "kind = 'Call' and name rlike '(^|[.])TypeVar$' and a['kw_covariant'] = 'True' and a['kw_contravariant'] = 'True'", "both covariant and contravariant"),
    ("PLC0132", "kind = 'Assign' and a['call_name'] rlike '(^|[.])(TypeVar|ParamSpec|NewType|TypeVarTuple)$' and a['targets'] = 'Name' and regexp_extract(a['value_src'], '[(][\\'\"]([^\\'\"]*)', 1) <> a['target_names']", "name differs from the variable"),
    ("PLC0205", "kind = 'Assign' and parent_kind = 'ClassDef' and a['target_names'] = '__slots__' and a['value_value'] rlike '^[\\'\"]'", "slots are one text"),
    ("PLC0207", "kind = 'Subscript' and a['text'] rlike '[.]r?split[(][^()]*[)]\\\\[(0|-1)\\\\]$' and a['text'] not like '%maxsplit%' and not a['text'] rlike '[.]r?split[(][^()]+, '", "split needs maxsplit"),
    ("PLC0415", "kind in ('Import','ImportFrom') and func is not null", "import inside a function"),
    ("PLC1802", "kind in ('If','While','IfExp') and a['src'] rlike '^(not )?len[(][^()]*[)]$'", "length as a condition"),
    ("PLC2403", "kind = 'alias' and not coalesce(a['asname'], name) rlike '^[\\\\x00-\\\\x7F]*$'", "imported name is not ASCII"),
    ("PLC2701", "kind = 'ImportFrom' and (a['names'] rlike '(^|,)_[^_]' or name rlike '(^|[.])_[^_]')", "private name imported"),
    ("PLE0302", f"{_METHOD} and not a['params'] rlike '[*]' and ((name in ({_ONE}) and a['n_params'] <> '1') or (name in ({_TWO}) and a['n_params'] <> '2') or (name = '__setitem__' and a['n_params'] <> '3')) and coalesce(a['param_defaults'], '') = ''", "special method with other parameters"),
    ("PLE0303", _returns("__len__", "coalesce(a['value_value'], '') rlike '^[0-9]+$'"), "length that is no number"),
    ("PLE0304", _returns("__bool__", "coalesce(a['value_value'], '') in ('True','False')"), "truth that is no bool"),
    ("PLE0305", _returns("__index__", "coalesce(a['value_value'], '') rlike '^-?[0-9]+$'"), "index that is no number"),
    ("PLE0307", _returns("__str__", "(a['value'] = 'JoinedStr' or coalesce(a['value_value'], '') rlike '^[\\'\"]')"), "text that is no str"),
    ("PLE0308", _returns("__bytes__", "coalesce(a['value_value'], '') rlike '^b[\\'\"]'"), "bytes that are none"),
    ("PLE0309", _returns("__hash__", "coalesce(a['value_value'], '') rlike '^-?[0-9]+$'"), "hash that is no number"),
    ("PLE0643", "kind = 'Subscript' and a['value_len'] is not null and a['slice_value'] rlike '^[0-9]+$' and try_cast(a['slice_value'] as int) >= try_cast(a['value_len'] as int)", "index outside the literal"),
    ("PLE0704", "kind = 'Raise' and a['src'] = '' and not in_handler and coalesce(in_function, '') <> '__exit__'", "bare raise outside a handler"),
    ("PLE1206", f"kind = 'Call' and {_LOG} and a['method'] in ('debug','info','warning','error','critical','exception') and a['arg0'] = 'Constant' and try_cast(a['n_args'] as int) > 1 and size(regexp_extract_all(replace(a['arg0_src'], '%%', ''), '%[-+0-9.]*[sdrfxa]', 0)) > try_cast(a['n_args'] as int) - 1", "too few arguments for the format"),
    ("PLE1300", "kind = 'BinOp' and a['op'] = 'Mod' and a['left'] = 'Constant' and replace(a['left_value'], '%%', '') rlike '%[-+ #0-9.]*[^-+ #0-9.*hlLdiouxXeEfFgGcrsa(%\\'\"]'", "unknown format character"),
    ("PLE1307", "kind = 'BinOp' and a['op'] = 'Mod' and a['left_value'] rlike '^[^%]*%[dioxXeEfFgG][^%]*$' and a['right_value'] rlike '^[\\'\"]'", "text for a number format"),
    ("PLE1310", "kind = 'Call' and a['method'] in ('strip','lstrip','rstrip') and a['arg0'] = 'Constant' and a['arg0_src'] rlike '^[\\'\"].*(.).*\\\\1.*[\\'\"]$'", "strip with a character twice"),
    ("PLE1519", f"{_DEF} and parent_kind = 'ClassDef' and a['decorators'] rlike '(^|,)(functools[.])?singledispatch(,|$)'", "singledispatch on a method"),
    ("PLE1520", f"{_DEF} and parent_kind <> 'ClassDef' and a['decorators'] rlike '(^|,)(functools[.])?singledispatchmethod(,|$)'", "singledispatchmethod on a function"),
    ("PLE1700", "kind = 'YieldFrom' and in_async", "yield from in an async function"),
    ("PLR0202", "kind = 'Assign' and parent_kind = 'ClassDef' and a['call_name'] = 'classmethod'", "classmethod without decorator"),
    ("PLR0203", "kind = 'Assign' and parent_kind = 'ClassDef' and a['call_name'] = 'staticmethod'", "staticmethod without decorator"),
    ("PLR0904", "kind = 'ClassDef' and size(filter(split(a['methods'], ','), m -> m <> '' and m not like '!_%' escape '!')) > 20", "too many public methods"),
    ("PLR0916", "kind in ('If','While') and a['test'] = 'BoolOp' and size(split(a['src'], ' (and|or) ')) > 5", "too many boolean parts"),
    ("PLR0917", f"{_DEF} and try_cast(a['n_positional'] as int) > 5", "too many positional parameters"),
    ("PLR1704", "kind in ('For','AsyncFor','withitem','ExceptHandler') and array_contains(split(coalesce(params_around, ''), ','), case kind when 'withitem' then a['optional_vars_name'] when 'ExceptHandler' then name else a['target_src'] end)", "argument redefined"),
    ("PLR1716", f"kind = 'BoolOp' and a['op'] = 'And' and (a['parts'] rlike '<=? ({_NAME}) ; \\\\1 <=? ' or a['parts'] rlike '>=? ({_NAME}) ; \\\\1 >=? ')", "comparisons can be chained"),
    ("PLR1730", f"kind = 'If' and a['orelse'] is null and a['src'] rlike '^({_NAME}) [<>]=? ({_NAME})$' and a['body_only'] in (concat(split(a['src'], ' ')[0], ' = ', split(a['src'], ' ')[2]), concat(split(a['src'], ' ')[2], ' = ', split(a['src'], ' ')[0]))", "use min or max"),
    ("PLR6104", "kind = 'Assign' and a['n_targets'] = '1' and a['value'] = 'BinOp' and a['targets'] in ('Name','Attribute','Subscript') and startswith(a['value_src'], concat(a['targets_src'], ' ')) and substring(a['value_src'], length(a['targets_src']) + 1) rlike '^ ([-+*/%&|^@]|//|<<|>>|[*][*]) [A-Za-z0-9_.\\'\"]+$'", "use an augmented assignment"),
    ("PLR6201", "kind = 'Compare' and a['op'] in ('In','NotIn') and a['right'] in ('List','Tuple') and a['right_src'] not in ('[]','()')", "use a set for membership"),
    ("PLW0101", "kind in ('Assign','AugAssign','AnnAssign','Expr','Return','If','For','While','With','Try','Raise','Assert','Import','ImportFrom','Pass','Delete') and prev_kind in ('Return','Raise','Break','Continue') and field in ('body','orelse','finalbody')", "code that is never reached"),
    ("PLW0108", f"kind = 'Lambda' and a['body'] = 'Call' and a['n_params'] <> '0' and a['params'] not like '%*%' and coalesce(a['param_defaults'], '') = '' and a['body_src'] = concat(regexp_extract(a['body_src'], '^({_NAME})[(]', 1), '(', replace(a['params'], ',', ', '), ')')", "lambda only calls"),
    ("PLW0128", "kind = 'Assign' and a['targets'] = 'Tuple' and size(filter(regexp_extract_all(a['targets_src'], '[A-Za-z_][A-Za-z0-9_]*', 0), x -> x <> '_')) > size(array_distinct(filter(regexp_extract_all(a['targets_src'], '[A-Za-z_][A-Za-z0-9_]*', 0), x -> x <> '_'))) and not a['targets_src'] rlike '[.\\\\[]'", "name assigned twice at once"),
    ("PLW0177", "kind = 'Compare' and (a['right_src'] rlike '^(float[(][\\'\"][nN]a[nN][\\'\"][)]|(math|np|numpy)[.](nan|NaN))$' or a['left_src'] rlike '^(float[(][\\'\"][nN]a[nN][\\'\"][)]|(math|np|numpy)[.](nan|NaN))$')", "comparison with NaN"),
    ("PLW0211", f"{_DEF} and parent_kind = 'ClassDef' and a['decorators'] rlike '(^|,)staticmethod(,|$)' and split(a['params'], ',')[0] in ('self','cls')", "static method with self"),
    ("PLW0245", "kind = 'Attribute' and a['value_name'] = 'super'", "super is not called"),
    ("PLW0406", "kind = 'Import' and array_contains(split(a['names'], ','), regexp_extract(path, '([^/]*)[.]py$', 1))", "module imports itself"),
    ("PLW0642", "kind = 'Assign' and in_class is not null and func is not null and a['targets_src'] in ('self','cls') and split(params_around, ',')[0] = a['targets_src']", "self is reassigned"),
    ("PLW1507", "kind = 'Call' and name = 'copy.copy' and a['arg0_src'] = 'os.environ'", "shallow copy of the environment"),
    ("PLW1641", "kind = 'ClassDef' and array_contains(split(a['methods'], ','), '__eq__') and not array_contains(split(a['methods'], ','), '__hash__') and not array_contains(split(a['fields'], ','), '__hash__')", "equality without hash"),
    ("PLW2101", "kind = 'With' and a['items_src'] rlike '(^|,)(threading[.])?(Lock|RLock|Condition|Semaphore|BoundedSemaphore)[(][)]'", "lock that nobody shares"),
    ("PLW3201", f"{_DEF} and parent_kind = 'ClassDef' and name rlike '^__.*__$' and name not in ({', '.join(repr(d) for d in DUNDERS)})", "unknown special method"),
    ("UP001", "kind = 'Assign' and a['target_names'] = '__metaclass__' and a['value_src'] = 'type'", "needless metaclass"),
    ("UP014", "kind = 'Assign' and a['call_name'] rlike '(^|[.])NamedTuple$'", "use a class"),
    ("UP017", "kind = 'Attribute' and name = 'utc' and a['value_name'] rlike '(^|[.])timezone$'", "use datetime.UTC"),
    ("UP019", "kind = 'Attribute' and name = 'Text' and a['value_name'] = 'typing'", "use str"),
    ("UP020", "kind = 'Call' and name = 'io.open'", "use open"),
    ("UP023", "kind in ('Import','ImportFrom') and (a['names'] like '%cElementTree%' or coalesce(name, '') like '%cElementTree')", "deprecated module"),
    ("UP029", "kind = 'ImportFrom' and name in ('builtins','six.moves.builtins')", "needless import of builtins"),
    ("UP030", "kind = 'Call' and a['method'] = 'format' and a['on_kind'] = 'Constant' and a['on'] rlike '[{][0-9]+[}]'", "needless positions in format"),
    ("UP040", "kind = 'AnnAssign' and a['annotation_src'] rlike '(^|[.])TypeAlias$' and a['value_src'] is not null", "use the type keyword"),
    ("UP041", "kind = 'Attribute' and (a['text'] in ('asyncio.TimeoutError','socket.timeout'))", "use TimeoutError"),
    ("UP042", "kind = 'ClassDef' and a['base_names'] rlike '(^|,)str,(enum[.])?Enum(,|$)'", "use StrEnum"),
    ("UP043", "kind = 'Subscript' and a['text'] rlike '^(typing[.]|collections[.]abc[.])?(Generator|AsyncGenerator)\\\\[.*, None(, None)?\\\\]$'", "default type arguments"),
    ("UP044", "kind = 'Subscript' and a['value_name'] rlike '(^|[.])Unpack$'", "use a star for unpacking"),
    ("UP046", "kind = 'ClassDef' and a['bases_src'] rlike '(^|,)(typing[.])?Generic\\\\['", "use type parameters"),
    ("UP050", "kind = 'ClassDef' and a['class_kw'] rlike '(^|,)metaclass=type(,|$)'", "needless metaclass"),
    ("PYI001", f"kind = 'Assign' and {_STUB} and a['call_name'] rlike '(^|[.])(TypeVar|ParamSpec|TypeVarTuple)$' and a['target_names'] not like '!_%' escape '!'", "type variable without underscore"),
    ("PYI006", "kind = 'Compare' and a['left_src'] = 'sys.version_info' and a['op'] not in ('Lt','GtE')", "use < or >= for versions"),
    ("PYI007", f"kind = 'Compare' and {_STUB} and a['left_src'] = 'sys.platform' and a['op'] not in ('Eq','NotEq')", "unknown platform check"),
    ("PYI008", f"kind = 'Compare' and {_STUB} and a['left_src'] = 'sys.platform' and a['op'] in ('Eq','NotEq') and a['right_src'] not in (\"'linux'\",\"'win32'\",\"'cygwin'\",\"'darwin'\")", "unknown platform"),
    ("PYI009", f"{_DEF} and {_STUB} and a['body'] = 'Pass'", "pass in a stub"),
    ("PYI010", f"{_DEF} and {_STUB} and a['n_body'] = '1' and a['body'] not in ('Pass') and coalesce(a['body_only'], '') <> '...' and a['doc'] is null", "stub with a body"),
    ("PYI012", f"kind = 'Pass' and {_STUB} and parent_kind = 'ClassDef' and siblings > 1", "needless pass in a class"),
    ("PYI013", "kind = 'Expr' and parent_kind = 'ClassDef' and a['text'] = '...' and siblings > 1", "needless ellipsis in a class"),
    ("PYI016", f"kind = 'BinOp' and a['op'] = 'BitOr' and a['text'] rlike '(^|[|] )({_NAME}) [|] (.* [|] )?\\\\2$'", "union member twice"),
    ("PYI017", f"kind = 'Assign' and {_STUB} and try_cast(a['n_targets'] as int) > 1", "several targets in a stub"),
    ("PYI020", f"kind in ('arg','AnnAssign') and {_STUB} and a['annotation_value'] rlike '^[\\'\"]'", "quoted annotation in a stub"),
    ("PYI021", f"kind in ('FunctionDef','AsyncFunctionDef','ClassDef','Module') and {_STUB} and a['doc'] is not null", "docstring in a stub"),
    ("PYI024", "kind = 'Call' and name = 'collections.namedtuple'", "use NamedTuple"),
    ("PYI025", "kind = 'alias' and name = 'Set' and coalesce(a['asname'], '') <> 'AbstractSet' and parent_name = 'collections.abc'", "import Set as AbstractSet"),
    ("PYI029", f"{_DEF} and {_STUB} and parent_kind = 'ClassDef' and name in ('__str__','__repr__') and a['n_params'] = '1'", "needless method in a stub"),
    ("PYI030", "kind = 'BinOp' and a['op'] = 'BitOr' and a['text'] rlike '(^|[|] )(typing[.])?Literal\\\\[[^\\\\]]*\\\\] [|] (.*[|] )?(typing[.])?Literal\\\\['", "join the literals"),
    ("PYI032", f"{_DEF} and name in ('__eq__','__ne__') and a['param_types'] rlike ':(typing[.])?Any(;|$)'", "use object"),
    ("PYI042", "kind = 'AnnAssign' and a['annotation_src'] rlike '(^|[.])TypeAlias$' and a['target_src'] rlike '^_?[a-z]'", "type alias in snake case"),
    ("PYI043", "kind = 'AnnAssign' and a['annotation_src'] rlike '(^|[.])TypeAlias$' and a['target_src'] rlike '^_.*[a-z0-9]T$'", "type alias with suffix T"),
    ("PYI044", f"kind = 'ImportFrom' and {_STUB} and name = '__future__' and a['names'] like '%annotations%'", "needless future import in a stub"),
    ("PYI045", f"{_DEF} and parent_kind = 'ClassDef' and ((name = '__iter__' and a['returns_src'] rlike '^(typing[.]|collections[.]abc[.])?Iterable') or (name = '__aiter__' and a['returns_src'] rlike '^(typing[.]|collections[.]abc[.])?AsyncIterable'))", "iterators are returned"),
    ("PYI048", f"{_DEF} and {_STUB} and try_cast(a['n_body'] as int) > 1 and a['doc'] is null", "stub of several statements"),
    ("PYI050", f"{_DEF} and {_STUB} and a['param_types'] rlike ':(typing[.])?NoReturn(;|$)'", "use Never"),
    ("PYI051", "kind = 'BinOp' and a['op'] = 'BitOr' and (a['text'] rlike 'Literal\\\\[[\\'\"][^\\\\]]*\\\\] [|] (.*[|] )?str$' or a['text'] rlike '^str [|] .*Literal\\\\[[\\'\"]' or a['text'] rlike 'Literal\\\\[[0-9][^\\\\]]*\\\\] [|] (.*[|] )?int$')", "literal beside its type"),
    ("PYI053", f"kind = 'Constant' and {_STUB} and a['type'] in ('str','bytes') and try_cast(a['chars'] as int) > 50 and parent_kind <> 'Expr'", "long text in a stub"),
    ("PYI054", f"kind = 'Constant' and {_STUB} and a['type'] = 'int' and length(value) > 10", "long number in a stub"),
    ("PYI055", "kind = 'BinOp' and a['op'] = 'BitOr' and a['text'] rlike '^(type|Type)\\\\[[^\\\\]]*\\\\] [|] (type|Type)\\\\['", "join the types"),
    ("PYI056", "kind = 'Call' and a['on'] = '__all__' and a['method'] in ('append','extend','remove')", "use += for exports"),
    ("PYI057", "kind in ('Attribute','alias') and (a['text'] in ('typing.ByteString','collections.abc.ByteString') or (kind = 'alias' and name = 'ByteString'))", "ByteString is gone"),
    ("PYI059", "kind = 'ClassDef' and a['bases_src'] rlike '(^|,)(typing[.])?Generic\\\\[[^\\\\]]*\\\\],'", "Generic comes last"),
    ("PYI062", "kind = 'Subscript' and a['text'] rlike '^(typing[.])?Literal\\\\[(.*, )?([^,]+), (.*, )?\\\\3(, .*)?\\\\]$'", "literal member twice"),
    ("PYI063", f"{_DEF} and exists(split(a['params'], ','), p -> p rlike '^__[a-z]' and not p rlike '__$')", "use a slash for positional-only parameters"),
    ("PYI064", "kind = 'AnnAssign' and a['annotation_src'] rlike '^(typing[.])?Final\\\\[(typing[.])?Literal\\\\['", "Final implies the literal"),
    ("SLOT000", "kind = 'ClassDef' and a['base_names'] rlike '(^|,)str(,|$)' and not a['base_names'] rlike 'Enum' and not array_contains(split(a['fields'], ','), '__slots__')", "str subclass without slots"),
    ("SLOT001", "kind = 'ClassDef' and a['base_names'] rlike '(^|,)tuple(,|$)' and not array_contains(split(a['fields'], ','), '__slots__')", "tuple subclass without slots"),
    ("SLOT002", "kind = 'ClassDef' and a['bases_src'] rlike '(^|,)(collections[.]|typing[.])?(namedtuple|NamedTuple)[(]' and not array_contains(split(a['fields'], ','), '__slots__')", "namedtuple subclass without slots"),
    ("PERF101", f"kind = 'For' and a['iter_src'] rlike '^(list|tuple)[(]{_NAME}[)]$'", "needless cast of an iterable"),
    ("PERF102", "kind = 'For' and a['iter_src'] like '%.items()' and (a['target_src'] rlike '^[(]?_[a-z]*, ' or a['target_src'] rlike ', _[a-z]*[)]?$')", "iterate over keys or values"),
    ("PERF203", "kind = 'Try' and parent_kind in ('For','While','AsyncFor') and field = 'body' and a['handlers'] is not null and siblings = 1", "try in a loop"),
    ("PERF402", "kind = 'For' and a['body_only'] rlike '^[A-Za-z_.]+[.](append|insert)[(]' and endswith(a['body_only'], concat('.append(', a['target_src'], ')'))", "copy of a list by hand"),
    ("TC005", "kind = 'If' and a['src'] in ('TYPE_CHECKING','typing.TYPE_CHECKING') and a['body'] = 'Pass'", "empty type checking block"),
    ("TC006", "kind = 'Call' and name = 'typing.cast' and a['arg0'] in ('Name','Attribute','Subscript','BinOp')", "type of a cast is quoted"),
    ("TC010", "kind = 'BinOp' and a['op'] = 'BitOr' and (a['left_value'] rlike '^[\\'\"]' or a['right_value'] rlike '^[\\'\"]')", "union with a text"),
    ("DJ001", "kind = 'Call' and in_class is not null and name rlike '(^|[.])(CharField|TextField|SlugField|EmailField|FilePathField|URLField)$' and a['kw_null'] = 'True' and not coalesce(a['kw_unique'], '') = 'True'", "nullable text field"),
    ("DJ003", "kind = 'Call' and name rlike '(^|[.])render$' and a['text'] like '%locals()%'", "locals passed to render"),
    ("DJ006", "kind = 'Assign' and in_class = 'Meta' and a['target_names'] = 'exclude'", "form with exclude"),
    ("DJ007", "kind = 'Assign' and in_class = 'Meta' and a['target_names'] = 'fields' and a['value_value'] rlike '__all__'", "form with all fields"),
    ("DJ008", "kind = 'ClassDef' and a['base_names'] rlike '(^|,)(django[.]db[.])?models[.]Model(,|$)' and not array_contains(split(a['methods'], ','), '__str__')", "model without __str__"),
    ("DJ013", f"{_DEF} and a['decorators'] rlike ',(django[.]dispatch[.])?receiver(,|$)'", "receiver is not the first decorator"),
    ("AIR001", "kind = 'Assign' and a['call_name'] rlike '(Operator|Sensor)$' and a['targets'] = 'Name' and a['value_src'] like '%task_id=%' and regexp_extract(a['value_src'], 'task_id=[\\'\"]([^\\'\"]*)', 1) <> a['target_names']", "task variable differs from its id"),
    ("AIR002", "kind = 'Call' and name rlike '(^|[.])DAG$' and not a['kw'] rlike 'schedule|timetable|[*][*]'", "DAG without schedule"),
    ("FAST001", f"{_DEF} and a['decorator_calls'] like '%response_model=%' and regexp_extract(a['decorator_calls'], 'response_model=([A-Za-z_.]+)', 1) = a['returns_src']", "response model equals the annotation"),
    ("FURB101", "kind = 'With' and a['items_src'] rlike '^open[(]' and a['body_only'] rlike '= [a-z_]+[.]read[(][)]$'", "use Path.read_text"),
    ("FURB103", "kind = 'With' and a['items_src'] rlike '^open[(]' and a['body_only'] rlike '^[a-z_]+[.]write[(]'", "use Path.write_text"),
    ("FURB110", "kind = 'IfExp' and a['src'] = a['body_src']", "use or"),
    ("FURB116", "kind = 'Subscript' and a['text'] rlike '^(bin|oct|hex)[(].*[)]\\\\[2:\\\\]$'", "use a format"),
    ("FURB122", "kind = 'For' and a['body_only'] rlike '^[a-z_]+[.]write[(]'", "use writelines"),
    ("FURB131", f"kind = 'Delete' and a['text'] rlike '^del {_NAME}\\\\[:\\\\]$'", "use clear"),
    ("FURB132", "kind = 'If' and a['orelse'] is null and a['src'] rlike '^[A-Za-z0-9_.\\'\"]+ in [A-Za-z_.]+$' and a['body_only'] = concat(split(a['src'], ' in ')[1], '.remove(', split(a['src'], ' in ')[0], ')')", "use discard"),
    ("FURB142", "kind = 'For' and a['body_only'] rlike '^[A-Za-z_.]+[.](add|discard)[(]' and endswith(a['body_only'], concat('(', a['target_src'], ')'))", "use update"),
    ("FURB145", f"kind = 'Assign' and a['value_src'] rlike '^{_NAME}\\\\[:\\\\]$'", "use copy"),
    ("FURB148", "kind = 'For' and a['iter_src'] like 'enumerate(%' and (a['target_src'] rlike '^[(]?_, ' or a['target_src'] rlike ', _[)]?$')", "needless enumerate"),
    ("FURB152", "kind = 'Constant' and value rlike '^(3[.]14[0-9]*|2[.]718[0-9]*|6[.]28[0-9]*)$'", "use the constant of math"),
    ("FURB154", "kind in ('Global','Nonlocal') and prev_kind = kind", "join the declarations"),
    ("FURB156", "kind = 'Constant' and value in (\"'0123456789'\",\"'abcdefghijklmnopqrstuvwxyz'\",\"'ABCDEFGHIJKLMNOPQRSTUVWXYZ'\",\"'01234567'\",\"'0123456789abcdefABCDEF'\")", "use the charset of string"),
    ("FURB157", "kind = 'Call' and name = 'decimal.Decimal' and a['arg0_src'] rlike '^[\\'\"]-?[0-9]+[\\'\"]$'", "use the number"),
    ("FURB161", "kind = 'Call' and a['text'] rlike '^bin[(].*[)][.]count[(][\\'\"]1[\\'\"][)]$'", "use bit_count"),
    ("FURB162", "kind = 'Call' and a['method'] = 'fromisoformat' and a['arg0_src'] rlike '[.]replace[(][\\'\"]Z[\\'\"], [\\'\"][+-]00:?00[\\'\"][)]$'", "needless replacement of Z"),
    ("FURB166", f"kind = 'Call' and name = 'int' and a['text'] rlike '^int[(]{_NAME}\\\\[2:\\\\], (base=)?(2|8|16)[)]$'", "use base 0"),
    ("FURB167", "kind = 'Attribute' and a['text'] rlike '^re[.][AILMSTUX]$'", "use the long flag"),
    ("FURB169", "kind = 'Compare' and a['left_src'] rlike '^type[(]' and a['right_src'] = 'type(None)'", "use is None"),
    ("FURB171", "kind = 'Compare' and a['op'] in ('In','NotIn') and a['right'] in ('List','Tuple','Set') and a['right_src'] rlike '^[\\\\[({][^,]+,?[\\\\])}]$'", "membership in one item"),
    ("FURB177", "kind = 'Call' and a['text'] rlike '^(pathlib[.])?Path[(][)][.]resolve[(][)]$'", "use Path.cwd"),
    ("FURB180", "kind = 'ClassDef' and a['class_kw'] rlike '(^|,)metaclass=(abc[.])?ABCMeta(,|$)'", "use ABC as base"),
    ("FURB181", "kind = 'Call' and a['method'] = 'hex' and a['on'] like '%.digest()'", "use hexdigest"),
    ("FURB189", "kind = 'ClassDef' and a['base_names'] rlike '(^|,)(dict|list|str)(,|$)' and a['base_names'] not rlike 'Enum'", "use the classes of collections"),
    ("FURB192", "kind = 'Subscript' and a['text'] rlike '^sorted[(].*[)]\\\\[(0|-1)\\\\]$'", "use min or max"),
    ("RUF006", "kind = 'Expr' and a['value'] = 'Call' and a['call_name'] rlike '(^|[.])(create_task|ensure_future)$'", "task is not kept"),
    ("RUF007", f"kind = 'Call' and name = 'zip' and a['text'] rlike '^zip[(]({_NAME}), \\\\1\\\\[1:\\\\]'", "use pairwise"),
    ("RUF008", "kind = 'AnnAssign' and parent_kind = 'ClassDef' and class_decorators rlike '(^|,)(dataclasses[.])?dataclass(,|$)' and a['value'] in ('List','Dict','Set','ListComp','DictComp','SetComp') and not a['annotation_src'] rlike 'ClassVar'", "mutable default of a dataclass"),
    ("RUF009", "kind = 'AnnAssign' and parent_kind = 'ClassDef' and class_decorators rlike '(^|,)(dataclasses[.])?dataclass(,|$)' and a['value'] = 'Call' and not a['call_name'] rlike '(^|[.])(field|Path|frozenset|tuple|Decimal|timedelta|MappingProxyType)$'", "call in a default of a dataclass"),
    ("RUF013", f"{_DEF} and a['none_defaults'] <> '' and exists(split(a['none_defaults'], ';'), t -> not t rlike 'Optional|None|Any|object|Union')", "implicit Optional"),
    ("RUF016", "kind = 'Subscript' and a['value'] in ('List','Tuple','Constant','JoinedStr') and a['slice_value'] rlike '^[\\'\"]'", "text as index"),
    ("RUF017", "kind = 'Call' and name = 'sum' and (a['arg1_src'] in ('[]','list()') or a['kw_start'] in ('[]','list()'))", "quadratic sum of lists"),
    ("RUF019", "kind = 'BoolOp' and a['op'] = 'And' and a['parts'] rlike '^([^ ]+) in ([A-Za-z_.]+) ; \\\\2\\\\[\\\\1\\\\]$'", "needless check of a key"),
    ("RUF020", "kind = 'BinOp' and a['op'] = 'BitOr' and a['text'] rlike '(^|[|] )(typing[.])?(Never|NoReturn)( [|]|$)'", "union with Never"),
    ("RUF022", "kind = 'Assign' and a['target_names'] = '__all__' and a['value'] in ('List','Tuple') and regexp_extract_all(a['value_src'], '[\\'\"]([^\\'\"]*)[\\'\"]', 1) <> array_sort(regexp_extract_all(a['value_src'], '[\\'\"]([^\\'\"]*)[\\'\"]', 1))", "exports are not sorted"),
    ("RUF023", "kind = 'Assign' and parent_kind = 'ClassDef' and a['target_names'] = '__slots__' and a['value'] in ('List','Tuple') and regexp_extract_all(a['value_src'], '[\\'\"]([^\\'\"]*)[\\'\"]', 1) <> array_sort(regexp_extract_all(a['value_src'], '[\\'\"]([^\\'\"]*)[\\'\"]', 1))", "slots are not sorted"),
    ("RUF026", "kind = 'Call' and name rlike '(^|[.])defaultdict$' and a['kw'] rlike '(^|,)default_factory(,|$)'", "default_factory is positional"),
    ("RUF032", "kind = 'Call' and name = 'decimal.Decimal' and a['arg0_src'] rlike '^-?[0-9]*[.][0-9]+$'", "Decimal of a float"),
    ("RUF033", f"{_DEF} and name = '__post_init__' and parent_kind = 'ClassDef' and a['param_defaults'] <> ''", "default in __post_init__"),
    ("RUF034", "kind = 'IfExp' and a['body_src'] = a['orelse_src']", "both branches are equal"),
    ("RUF036", "kind = 'BinOp' and a['op'] = 'BitOr' and a['text'] rlike '^None [|]' and parent_kind <> 'BinOp'", "None comes last in a union"),
    ("RUF037", "kind = 'Call' and name rlike '(^|[.])deque$' and a['arg0_src'] in ('[]','list()','()','tuple()')", "needless empty iterable"),
    ("RUF038", "kind = 'Subscript' and a['text'] rlike '^(typing[.])?Literal\\\\[(True, False|False, True)\\\\]$'", "use bool"),
    ("RUF040", "kind = 'Assert' and a['msg_value'] rlike '^[0-9TF]'", "message is no text"),
    ("RUF041", "kind = 'Subscript' and a['value_name'] rlike '(^|[.])Literal$' and a['text'] rlike 'Literal\\\\[.*Literal\\\\['", "nested literal"),
    ("RUF046", "kind = 'Call' and name = 'int' and a['n_args'] = '1' and a['kw'] = '' and a['arg0_src'] rlike '^(len|ord|id|hash|round|math[.](ceil|floor|trunc))[(][^,]*[)]$'", "needless cast to int"),
    ("RUF047", "kind in ('If','For','While','Try') and a['orelse'] = 'Pass'", "needless else"),
    ("RUF048", "kind = 'Call' and name = 'map' and a['arg0_src'] = 'int' and a['arg1_src'] rlike '__version__[.]split[(]'", "version parts may be no numbers"),
    ("RUF049", "kind = 'ClassDef' and a['decorators'] rlike '(^|,)(dataclasses[.])?dataclass(,|$)' and a['base_names'] rlike '(^|[.,])(Enum|IntEnum|StrEnum|Flag)(,|$)'", "dataclass of an enum"),
    ("RUF051", "kind = 'If' and a['orelse'] is null and a['src'] rlike '^[^ ]+ in [A-Za-z_.]+$' and a['body_only'] = concat('del ', split(a['src'], ' in ')[1], '[', split(a['src'], ' in ')[0], ']')", "use pop"),
    ("RUF056", "kind = 'Call' and a['method'] = 'get' and a['n_args'] = '2' and a['arg1_src'] in ('False','0','[]','{}','()',\"''\",'None') and (parent_kind in ('If','While','BoolOp','Assert') or (parent_kind = 'UnaryOp' and field = 'operand')) and field in ('test','values','operand')", "falsy fallback in a condition"),
    ("RUF057", "kind = 'Call' and name = 'round' and a['arg0_src'] rlike '^(-?[0-9]+|len[(].*[)])$'", "needless round"),
    ("RUF058", "kind = 'Call' and name = 'itertools.starmap' and a['arg1_src'] rlike '^zip[(]'", "use map"),
    ("RUF060", "kind = 'Compare' and a['op'] in ('In','NotIn') and a['right_src'] in ('[]','()','{}','set()','list()','dict()','tuple()',\"''\")", "membership in nothing"),
    ("B014", "kind = 'ExceptHandler' and a['type'] = 'Tuple' and size(split(regexp_replace(a['type_src'], '[() ]', ''), ',')) > size(array_distinct(split(regexp_replace(a['type_src'], '[() ]', ''), ',')))", "exception named twice"),
    ("B020", "kind in ('For','AsyncFor') and a['target_src'] = a['iter_src']", "loop overrides its iterable"),
    ("B021", "kind in ('FunctionDef','AsyncFunctionDef','ClassDef','Module') and a['first'] = 'JoinedStr'", "f-string as docstring"),
    ("B027", f"{_DEF} and parent_kind = 'ClassDef' and class_bases rlike '(^|,)(abc[.])?ABC(,|$)' and not coalesce(a['decorators'], '') rlike 'abstract|overload' and (a['body'] = 'Pass' or a['body_only'] = '...')", "empty method of an abstract class"),
    ("B030", "kind = 'ExceptHandler' and a['type'] in ('Constant','List','Dict','Set','JoinedStr')", "handler of no exception"),
    ("B035", "kind = 'DictComp' and a['key'] = 'Constant'", "constant key in a comprehension"),
    ("B039", "kind = 'Call' and name rlike '(^|[.])ContextVar$' and a['kw_default'] rlike '^([\\\\[{]|(list|dict|set)[(])'", "mutable default of a context variable"),
    ("B043", "kind = 'Call' and name = 'delattr' and a['arg1'] = 'Constant' and a['arg1_src'] rlike '^[\\'\"][A-Za-z_]+[\\'\"]$'", "delattr with a constant"),
    ("B911", "kind = 'Call' and name = 'itertools.batched' and a['kw'] not like '%strict%'", "batched without strict"),
    ("A003", f"{_DEF} and parent_kind = 'ClassDef' and name in ('id','type','list','dict','set','str','int','max','min','sum','filter','map','format','input','print','hash','iter','next','open','range','vars','zip')", "method hides a builtin"),
    ("ASYNC109", "kind = 'AsyncFunctionDef' and array_contains(split(a['params'], ','), 'timeout')", "timeout parameter of an async function"),
    ("ASYNC110", "kind = 'While' and a['body_only'] rlike '^await (asyncio|trio|anyio)[.]sleep[(]'", "busy wait"),
    ("ASYNC115", "kind = 'Call' and name in ('trio.sleep','anyio.sleep') and a['arg0_src'] = '0'", "use checkpoint"),
    ("ASYNC116", "kind = 'Call' and name in ('trio.sleep','anyio.sleep') and a['arg0_src'] rlike '^[0-9]+$' and try_cast(a['arg0_src'] as bigint) > 86400", "use sleep_forever"),
    ("ASYNC212", "kind = 'Call' and in_async and name rlike '^httpx[.](get|post|put|delete|patch|head|options|request)$'", "blocking client in an async function"),
    ("ASYNC220", "kind = 'Call' and in_async and name in ('subprocess.Popen','os.popen')", "process made in an async function"),
    ("ASYNC221", "kind = 'Call' and in_async and name in ('subprocess.run','subprocess.call','subprocess.check_call','subprocess.check_output','os.system')", "process run in an async function"),
    ("ASYNC222", "kind = 'Call' and in_async and name in ('os.wait','os.wait3','os.wait4','os.waitid','os.waitpid')", "process awaited in an async function"),
    ("ASYNC250", "kind = 'Call' and in_async and name = 'input'", "input in an async function"),
    ("DTZ002", "kind = 'Call' and name = 'datetime.datetime.today'", "today has no zone"),
    ("DTZ007", "kind = 'Call' and name = 'datetime.datetime.strptime' and a['arg1'] = 'Constant' and a['arg1_src'] not like '%\\%z%' and parent_kind <> 'Attribute'", "strptime without zone"),
    ("DTZ012", "kind = 'Call' and name = 'datetime.date.fromtimestamp'", "fromtimestamp has no zone"),
    ("DTZ901", "kind = 'Attribute' and a['text'] in ('datetime.datetime.min','datetime.datetime.max')", "extreme without zone"),
    ("SIM212", "kind = 'IfExp' and a['src'] = concat('not ', a['orelse_src'])", "arms are twisted"),
    ("SIM401", "kind = 'If' and a['src'] rlike '^[^ ]+ in [A-Za-z_.]+$' and a['body_only'] rlike '^[A-Za-z_.]+ = ' and endswith(a['body_only'], concat(' = ', split(a['src'], ' in ')[1], '[', split(a['src'], ' in ')[0], ']')) and split(a['body_only'], ' = ')[0] = split(a['orelse_only'], ' = ')[0]", "use get"),
    ("SIM911", "kind = 'Call' and name = 'zip' and a['text'] rlike '^zip[(]([A-Za-z_.]+)[.]keys[(][)], \\\\1[.]values[(][)]'", "use items"),
    ("FBT001", f"{_DEF} and a['positional_types'] rlike ':bool(;|$)'", "positional parameter of type bool"),
    ("FBT002", f"{_DEF} and a['positional_defaults'] rlike '=(True|False)(;|$)'", "positional truth value default"),
    ("S107", f"{_DEF} and lower(a['param_defaults']) rlike '(^|;)[a-z_]*(pass(word|wd)?|secret|token)=[\\'\"].'", "hard-coded password default"),
    ("S201", "kind = 'Call' and a['method'] = 'run' and a['kw_debug'] = 'True'", "debug mode"),
    ("S503", f"{_DEF} and a['param_defaults'] rlike 'PROTOCOL_(SSLv2|SSLv3|TLSv1)'", "insecure protocol default"),
    ("S505", "kind = 'Call' and name rlike '(rsa|dsa)[.]generate_private_key$' and try_cast(coalesce(a['kw_key_size'], a['arg1_src']) as int) < 2048", "weak key"),
    ("S509", "kind = 'Call' and name = 'pysnmp.hlapi.UsmUserData' and try_cast(coalesce(a['n_args'], '0') as int) < 3", "unencrypted user"),
    ("S601", "kind = 'Call' and a['method'] = 'exec_command'", "remote command"),
    ("S612", "kind = 'Call' and name = 'logging.config.listen' and a['kw'] not like '%verify%'", "listener without verification"),
    ("S704", "kind = 'Call' and name = 'markupsafe.Markup' and a['arg0'] <> 'Constant'", "markup of a variable"),
    ("TRY301", "kind = 'Raise' and (parent_kind = 'Try' and field = 'body') and a['src'] <> ''", "raise within try"),
    ("TRY401", "kind = 'Call' and in_handler and a['method'] = 'exception' and handler_name is not null and a['text'] rlike concat('[^A-Za-z_.]', handler_name, '[^A-Za-z_]')", "needless exception in the message"),
    ("PD003", "kind = 'Call' and a['method'] = 'isnull'", "use isna"),
    ("PD004", "kind = 'Call' and a['method'] = 'notnull'", "use notna"),
    ("PD007", "kind = 'Attribute' and name = 'ix' and field = 'value' and parent_kind = 'Subscript'", "use loc or iloc"),
    ("PD008", "kind = 'Attribute' and name = 'at' and field = 'value' and parent_kind = 'Subscript'", "use loc"),
    ("PD009", "kind = 'Attribute' and name = 'iat' and field = 'value' and parent_kind = 'Subscript'", "use iloc"),
    ("PD010", "kind = 'Call' and a['method'] in ('pivot','unstack') and a['on'] not in ('self')", "use pivot_table"),
    ("PD012", "kind = 'Call' and name in ('pandas.read_table')", "use read_csv"),
    ("PD013", "kind = 'Call' and a['method'] = 'stack' and a['on'] not in ('np','numpy','torch','tf','self')", "use melt"),
    ("PD015", "kind = 'Call' and name = 'pandas.merge'", "use the method merge"),
    ("PD101", "kind = 'Compare' and a['left_src'] like '%.nunique()' and a['right_src'] = '1'", "nunique to find a constant"),
    ("N811", "kind = 'alias' and name rlike '^[A-Z][A-Z0-9_]+$' and a['asname'] rlike '[a-z]'", "constant imported as something else"),
    ("N812", "kind = 'alias' and name rlike '^[a-z][a-z0-9_]*$' and a['asname'] rlike '[A-Z]'", "lower case imported as something else"),
    ("N813", "kind = 'alias' and name rlike '^[A-Z].*[a-z]' and a['asname'] rlike '^[a-z0-9_]+$'", "class imported in lower case"),
    ("N814", "kind = 'alias' and name rlike '^[A-Z].*[a-z]' and a['asname'] rlike '^[A-Z][A-Z0-9_]+$' and a['asname'] <> regexp_replace(name, '[^A-Z]', '')", "class imported as a constant"),
    ("N817", "kind = 'alias' and name rlike '^[A-Z].*[a-z]' and a['asname'] = regexp_replace(name, '[^A-Z]', '')", "class imported as an acronym"),
    ("N815", "kind = 'Name' and a['ctx'] = 'Store' and in_class is not null and func is null and name rlike '^_*[a-z]+[a-z0-9]*[A-Z]'", "mixed case in a class"),
    ("N816", "kind = 'Name' and a['ctx'] = 'Store' and scope = 0 and name rlike '^_*[a-z]+[a-z0-9]*[A-Z]'", "mixed case in a module"),
    ("N999", "kind = 'Module' and not regexp_extract(path, '([^/]*)[.]pyi?$', 1) rlike '^[a-z0-9_]*$'", "module name"),
    ("PT008", "kind = 'Call' and name rlike '(^|[.])patch([.]object)?$' and coalesce(a['kw_new'], a['arg1_src'], a['arg2_src']) like 'lambda%:%'", "patch with a lambda"),
    ("PT010", "kind = 'Call' and name = 'pytest.raises' and a['n_args'] is null and a['kw'] not like '%expected_exception%'", "raises without an exception"),
    ("PT012", "kind = 'With' and a['items_src'] rlike '(^|,)pytest[.]raises[(]' and try_cast(a['n_body'] as int) > 1", "several statements in raises"),
    ("PT016", "kind = 'Call' and name = 'pytest.fail' and a['n_args'] is null and a['kw'] = ''", "fail without a message"),
    ("PT023", "kind in ('FunctionDef','AsyncFunctionDef','ClassDef') and a['decorator_calls'] rlike '(^|,)pytest[.]mark[.](?!usefixtures)[a-z_]+[(][)](,|$)'", "needless parentheses on a mark"),
    ("PT026", "kind in ('FunctionDef','AsyncFunctionDef','ClassDef') and a['decorator_calls'] rlike '(^|,)pytest[.]mark[.]usefixtures[(][)](,|$)'", "usefixtures without fixtures"),
    ("PT028", f"{_DEF} and name like 'test!_%' escape '!' and a['param_defaults'] <> ''", "test parameter with a default"),
    ("PT029", "kind = 'Call' and name = 'pytest.warns' and a['n_args'] is null and a['kw'] not like '%expected_warning%'", "warns without a warning"),
    ("PT030", "kind = 'Call' and name = 'pytest.warns' and a['arg0_src'] in ('Warning','UserWarning','DeprecationWarning') and a['kw'] not like '%match%'", "warns is too broad"),
    ("PT031", "kind = 'With' and a['items_src'] rlike '(^|,)pytest[.]warns[(]' and try_cast(a['n_body'] as int) > 1", "several statements in warns"),
    ("LOG004", f"kind = 'Call' and {_LOG} and a['method'] = 'exception' and not in_handler", "exception logged outside a handler"),
    ("LOG007", f"kind = 'Call' and {_LOG} and a['method'] = 'exception' and a['kw_exc_info'] = 'False'", "exception without its trace"),
    ("LOG014", f"kind = 'Call' and {_LOG} and a['method'] in ('debug','info','warning','error','critical') and a['kw_exc_info'] = 'True' and not in_handler", "exc_info outside a handler"),
    ("ISC003", "kind = 'BinOp' and a['op'] = 'Add' and a['left_value'] rlike '^[\\'\"]' and a['right_value'] rlike '^[\\'\"]'", "literals joined by +"),
    ("INT002", "kind = 'Call' and name in ('_','gettext','ngettext') and a['arg0_src'] rlike '[.]format[(]'", "format in a translation"),
    ("INT003", "kind = 'Call' and name in ('_','gettext','ngettext') and a['arg0'] = 'BinOp' and a['arg0_src'] like '% \\% %'", "percent format in a translation"),
    ("NPY003", "kind = 'Call' and name rlike '^numpy[.](round_|product|cumproduct|sometrue|alltrue)$'", "deprecated function"),
    ("PGH005", "kind = 'Expr' and (a['call_name'] rlike '[.](not_called|called_once|called_once_with|called_with|has_calls|any_call)$' or (a['value'] = 'Attribute' and a['text'] rlike '[.](assert_called|assert_called_once|assert_not_called|called_once)$'))", "mock assertion does nothing"),
]
#: (code, condition over tokens and their neighbours, message).
TOKEN_RULES = [
    ("E111", "kind = 'INDENT' and text rlike '^ *$' and length(text) % 4 <> 0", "indentation is no multiple of four"),
    ("E204", "kind = 'AT' and (p_kind is null or p_kind in ('NEWLINE','NL','INDENT','DEDENT','COMMENT')) and n_row = row and n_col > end_col", "blank after the sign of a decorator"),
    ("E262", "kind = 'COMMENT' and p_end_row = row and p_kind not in ('NL','NEWLINE','INDENT','DEDENT') and text rlike '^#([^ :!#]|  )'", "inline comment starts with one blank"),
    ("E271", "kind = 'NAME' and text in ('and','or','not','in','is','if','elif','while','for','from','import','return','yield','assert','raise','del','lambda','with','as','class','def') and n_row = end_row and n_col - end_col > 1 and n_kind not in ('COMMENT','NEWLINE','NL')", "several blanks after a keyword"),
    ("E272", "kind = 'NAME' and text in ('and','or','in','is','if','else','for','import','as') and p_end_row = row and col - p_end_col > 1 and p_kind not in ('NEWLINE','NL','INDENT','DEDENT')", "several blanks before a keyword"),
    ("E275", "kind = 'NAME' and text in ('and','or','not','in','is','if','elif','while','return','assert','raise','del','from','import') and n_row = end_row and n_col = end_col and n_kind in ('LPAR','LSQB','LBRACE','STRING','NUMBER')", "no blank after a keyword"),
    ("E502", "kind not in ('NL','NEWLINE','COMMENT','INDENT','DEDENT') and n_kind not in ('NL','NEWLINE','COMMENT') and n_row > end_row and depth + if(kind in ('LPAR','LSQB','LBRACE'), 1, 0) > 0", "needless backslash in brackets"),
    ("ISC002", "kind = 'STRING' and n_kind = 'STRING' and n_row > end_row and depth = 0", "literals joined across lines"),
    ("PLR2044", "kind = 'COMMENT' and text rlike '^#+ *$' and (p_kind is null or p_kind in ('NL','NEWLINE','INDENT','DEDENT')) and n_kind <> 'COMMENT'", "empty comment"),
    ("UP025", "kind = 'STRING' and text rlike '^[uU][\\'\"]'", "needless prefix u"),
]
#: (code, condition over lines, message).
LINE_RULES = [
    ("E114", "line rlike '^ +#' and (length(line) - length(ltrim(line))) % 4 <> 0", "comment indentation is no multiple of four"),
    ("E266", "line rlike '^ *##+[^#]'", "several signs before a block comment"),
    ("E273", "line rlike '(^|[^A-Za-z0-9_])(and|or|not|in|is|if|import|from|return|for|while)\\t'", "tab after a keyword"),
    ("E274", "line rlike '[^ \\t]\\t+(and|or|in|is|if|else|for|import|as)[ \\t]'", "tab before a keyword"),
    ("PLE2510", "line rlike '\\\\x08'", "backspace in a source"),
    ("PLE2512", "line rlike '\\\\x1A'", "substitute character in a source"),
    ("PLE2513", "line rlike '\\\\x1B'", "escape character in a source"),
    ("RUF054", "line rlike '^[ \\t]+\\\\f'", "form feed after blanks"),
    ("UP009", "line_no <= 2 and line rlike '^#.*coding[:=] *(utf-8|UTF-8|utf8)'", "needless encoding"),
    ("UP039", "line rlike '^ *class +[A-Za-z_0-9]+[(] *[)] *:'", "needless parentheses of a class"),
    ("PYI033", "path like '%.pyi' and line rlike '# type: (?!ignore)'", "type comment in a stub"),
    ("EXE003", "line_no = 1 and line like '#!%' and line not like '%python%' and line not like '%pytest%'", "shebang without python"),
    ("EXE004", "line_no = 1 and line rlike '^[ \\t]+#!'", "blank before the shebang"),
    ("EXE005", "line_no > 1 and line rlike '^#!/'", "shebang below the first line"),
    ("ERA001", "line rlike '^ *# *((from [a-z_.]+ )?import [a-z_.]+|return [^ ]+|(if|while|for|with|elif) .*:|else:|try:|def [a-z_]+[(].*:|class [A-Za-z_]+.*:|[a-z_.]+ = [^=]+|[a-z_.]+[(].*[)]) *$'", "code in a comment"),
]
CODES = [r[0] for table in (NODE_RULES, TOKEN_RULES, LINE_RULES) for r in table]
