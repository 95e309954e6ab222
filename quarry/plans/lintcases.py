"""A source that meets each lint rule and one that does not."""

from __future__ import annotations

#: (code, source that meets the rule, source that does not); {k} stands for a number of the file's own.
CASES = [
    # names, imports and statements
    ("F401", "import os\nx = {k}\n", "import os\nx = os\n"),
    ("F402", "import os\nfor os in [{k}]:\n    print(os)\n", "import os\nfor o in [{k}]:\n    print(os, o)\n"),
    ("F403", "from os import *\n", "from os import path\n"),
    ("F404", "x = 1\nfrom __future__ import annotations\n", "'''d'''\nfrom __future__ import annotations\nx = 1\n"),
    ("F405", "from os import *\nprint(getcwd_{k})\n", "from os import *\nx = 1\nprint(x)\n"),
    ("F406", "def f():\n    from os import *\n", "from os import *\n"),
    ("F407", "from __future__ import nothing\n", "from __future__ import division\n"),
    ("F502", "'%(a)s' % (1, {k})\n", "'%(a)s' % {'a': {k}}\n"),
    ("F541", "x = f'a{k}'\n", "y = 1\nx = f'{y}'\n"),
    ("F601", "x = {'a': 1, 'a': {k}}\n", "x = {'a': 1, 'b': {k}}\n"),
    ("F622", "*a, *b = [{k}]\n", "*a, b = [{k}]\n"),
    ("F631", "assert (x, 'y{k}')\n", "assert x, 'y{k}'\n"),
    ("F632", "x is 'a{k}'\n", "x == 'a{k}'\n"),
    ("F633", "print >> f, {k}\n", "x >> f\n"),
    ("F634", "if (x, {k}):\n    pass\n", "if x:\n    pass\n"),
    ("F701", "break\n", "while x:\n    break\n"),
    ("F702", "def f():\n    continue\n", "for x in y:\n    continue\n"),
    ("F704", "yield {k}\n", "def f():\n    yield {k}\n"),
    ("F706", "return {k}\n", "def f():\n    return {k}\n"),
    ("F707", "try:\n    f()\nexcept:\n    g()\nexcept ValueError:\n    h({k})\n", "try:\n    f()\nexcept ValueError:\n    h({k})\nexcept:\n    g()\n"),
    ("F722", "x: 'a b{k}' = 1\n", "x: 'a{k}' = 1\n"),
    ("F811", "def f():\n    return 1\n\n\ndef f():\n    return {k}\n", "def f():\n    return 1\n\n\nprint(f)\n\n\ndef f():\n    return {k}\n"),
    ("F821", "print(name_{k})\n", "name_{k} = 1\nprint(name_{k})\n"),
    ("F822", "__all__ = ['name_{k}']\n", "__all__ = ['name_{k}']\nname_{k} = 1\n"),
    ("F841", "def f():\n    x = {k}\n    return 1\n", "def f():\n    x = {k}\n    return x\n"),
    ("F842", "def f():\n    x: int\n    return {k}\n", "def f():\n    x: int = 1\n    return {k}\n"),
    ("F901", "raise NotImplemented\n", "raise NotImplementedError\n"),
    # layout
    ("E101", "if x:\n    \ty = {k}\n", "if x:\n    y = {k}\n"),
    ("E111", "if x:\n   y = {k}\n", "if x:\n    y = {k}\n"),
    ("E114", "if x:\n   # a\n    y = {k}\n", "if x:\n    # a\n    y = {k}\n"),
    ("E201", "f( {k})\n", "f({k})\n"),
    ("E202", "f({k} )\n", "f({k})\n"),
    ("E203", "f(1 , {k})\n", "f(1, {k})\n"),
    ("E204", "@ a\ndef f():\n    return {k}\n", "@a\ndef f():\n    return {k}\n"),
    ("E211", "f ({k})\n", "f({k})\n"),
    ("E231", "f(1,{k})\n", "f(1, {k})\n"),
    ("E261", "x = {k} # a\n", "x = {k}  # a\n"),
    ("E262", "x = {k}  #a\n", "x = {k}  # a\n"),
    ("E265", "#a{k}\n", "# a{k}\n"),
    ("E266", "## a{k}\n", "# a{k}\n"),
    ("E271", "x = not  y\n", "x = not y\n"),
    ("E272", "x = y  and z\n", "x = y and z\n"),
    ("E273", "x = not\ty\n", "x = not y\n"),
    ("E274", "x = y\tand z\n", "x = y and z\n"),
    ("E275", "x = not(y)\n", "x = not (y)\n"),
    ("E401", "import a, b{k}\n", "import a\nimport b{k}\n"),
    ("E402", "x = {k}\nimport os\n", "import os\nx = {k}\n"),
    ("E501", "x = '" + "a b " * 30 + "{k}'\n", "x = 'a b {k}'\n"),
    ("E502", "f(1, \\\n  {k})\n", "f(1,\n  {k})\n"),
    ("E701", "if x: y = {k}\n", "if x:\n    y = {k}\n"),
    ("E702", "x = 1; y = {k}\n", "x = 1\ny = {k}\n"),
    ("E703", "x = {k};\n", "x = {k}\n"),
    ("E711", "x < y == None\n", "x is None\n"),
    ("E712", "if x == True:\n    y = {k}\n", "if x:\n    y = {k}\n"),
    ("E713", "if not x in y:\n    z = {k}\n", "if x not in y:\n    z = {k}\n"),
    ("E714", "if not x is y:\n    z = {k}\n", "if x is not y:\n    z = {k}\n"),
    ("E721", "type(a) == type({k})\n", "isinstance(a, int)\n"),
    ("E722", "try:\n    f()\nexcept:\n    g({k})\n", "try:\n    f()\nexcept ValueError:\n    g({k})\n"),
    ("E731", "f = lambda: {k}\n", "def f():\n    return {k}\n"),
    ("E741", "def f(l):\n    return {k}\n", "def f(a):\n    return {k}\n"),
    ("E742", "class I:\n    x = {k}\n", "class A:\n    x = {k}\n"),
    ("E743", "def O():\n    return {k}\n", "def a():\n    return {k}\n"),
    ("E999", "x = (\n", "x = ({k})\n"),
    ("W191", "if x:\n\ty = {k}\n", "if x:\n    y = {k}\n"),
    ("W291", "x = {k} \n", "x = {k}\n"),
    ("W292", "x = {k}", "x = {k}\n"),
    ("W293", "x = 1\n  \ny = {k}\n", "x = 1\n\ny = {k}\n"),
    ("W391", "x = {k}\n\n", "x = {k}\n"),
    ("W605", "x = '\\d{k}'\n", "x = r'\\d{k}'\n"),
    # likely bugs
    ("B002", "++x\n", "+x\n"),
    ("B003", "import os\nos.environ = {'a': {k}}\n", "import os\nos.environ['a'] = 'b'\n"),
    ("B004", "hasattr(x, '__call__')\n", "callable(x)\n"),
    ("B005", "x.strip('abca')\n", "x.strip('abc')\n"),
    ("B006", "def f(x=[]):\n    return {k}\n", "def f(x=()):\n    return {k}\n"),
    ("B007", "for i in range({k}):\n    print(1)\n", "for i in range({k}):\n    print(i)\n"),
    ("B008", "def f(x=g({k})):\n    return x\n", "def f(x=None):\n    return x\n"),
    ("B009", "getattr(x, 'y')\n", "getattr(x, y)\n"),
    ("B010", "setattr(x, 'y', {k})\n", "setattr(x, y, {k})\n"),
    ("B011", "assert False\n", "assert x\n"),
    ("B012", "def f():\n    try:\n        g()\n    finally:\n        return {k}\n", "def f():\n    try:\n        g()\n    finally:\n        h({k})\n"),
    ("B014", "try:\n    f()\nexcept (ValueError, ValueError):\n    g({k})\n", "try:\n    f()\nexcept (ValueError, KeyError):\n    g({k})\n"),
    ("B015", "x == {k}\n", "y = x == {k}\n"),
    ("B016", "raise 'a{k}'\n", "raise ValueError\n"),
    ("B017", "self.assertRaises(Exception)\n", "self.assertRaises(ValueError)\n"),
    ("B018", "x + {k}\n", "y = x + {k}\n"),
    ("B019", "class A:\n    @lru_cache\n    def f(self):\n        return {k}\n", "@lru_cache\ndef f():\n    return {k}\n"),
    ("B020", "for x in x:\n    print(x, {k})\n", "for x in y:\n    print(x, {k})\n"),
    ("B021", "def f():\n    f'''a{x}'''\n    return {k}\n", "def f():\n    '''a'''\n    return {k}\n"),
    ("B022", "import contextlib\nwith contextlib.suppress():\n    f({k})\n", "import contextlib\nwith contextlib.suppress(ValueError):\n    f({k})\n"),
    ("B024", "from abc import ABC\nclass A(ABC):\n    x = {k}\n", "from abc import ABC\nclass A(ABC):\n    def f(self):\n        return {k}\n"),
    ("B025", "try:\n    f()\nexcept ValueError:\n    g()\nexcept ValueError:\n    h({k})\n", "try:\n    f()\nexcept ValueError:\n    g()\nexcept KeyError:\n    h({k})\n"),
    ("B026", "f(a={k}, *b)\n", "f(*b, a={k})\n"),
    ("B027", "from abc import ABC\nclass A(ABC):\n    def f(self):\n        pass\n", "from abc import ABC, abstractmethod\nclass A(ABC):\n    @abstractmethod\n    def f(self):\n        pass\n"),
    ("B028", "import warnings\nwarnings.warn('a{k}')\n", "import warnings\nwarnings.warn('a{k}', stacklevel=2)\n"),
    ("B029", "try:\n    f()\nexcept ():\n    g({k})\n", "try:\n    f()\nexcept ValueError:\n    g({k})\n"),
    ("B030", "try:\n    f()\nexcept {k}:\n    g()\n", "try:\n    f()\nexcept ValueError:\n    g({k})\n"),
    ("B032", "x.y: {k}\n", "x.y: int = {k}\n"),
    ("B033", "x = {1, 2, 1}\n", "x = {1, 2, 3}\n"),
    ("B034", "import re\nre.sub('a', 'b', x, {k})\n", "import re\nre.sub('a', 'b', x, count={k})\n"),
    ("B035", "x = {'a': y for y in z}\n", "x = {y: 'a' for y in z}\n"),
    ("B039", "from contextvars import ContextVar\nx = ContextVar('x', default=[])\n", "from contextvars import ContextVar\nx = ContextVar('x', default=None)\n"),
    ("B043", "delattr(x, 'y')\n", "delattr(x, y)\n"),
    ("B904", "try:\n    f()\nexcept ValueError:\n    raise KeyError({k})\n", "try:\n    f()\nexcept ValueError as e:\n    raise KeyError({k}) from e\n"),
    ("B905", "zip(a, b)\n", "zip(a, b, strict=True)\n"),
    ("B911", "import itertools\nitertools.batched(x, {k})\n", "import itertools\nitertools.batched(x, {k}, strict=True)\n"),
    ("BLE001", "try:\n    f()\nexcept Exception:\n    g({k})\n", "try:\n    f()\nexcept ValueError:\n    g({k})\n"),
    ("A001", "list = {k}\n", "lists = {k}\n"),
    ("A002", "def f(id):\n    return {k}\n", "def f(key):\n    return {k}\n"),
    ("A003", "class A:\n    def filter(self):\n        return {k}\n", "class A:\n    def chosen(self):\n        return {k}\n"),
    ("A004", "from a import open\n", "from a import opened\n"),
    ("ASYNC109", "async def f(timeout):\n    await g({k})\n", "async def f(seconds):\n    await g({k})\n"),
    ("ASYNC110", "import asyncio\nasync def f():\n    while x:\n        await asyncio.sleep({k})\n", "async def f():\n    while x:\n        await g({k})\n"),
    ("ASYNC115", "import trio\nasync def f():\n    await trio.sleep(0)\n", "import trio\nasync def f():\n    await trio.sleep({k})\n"),
    ("ASYNC116", "import trio\nasync def f():\n    await trio.sleep(86401)\n", "import trio\nasync def f():\n    await trio.sleep(5)\n"),
    ("ASYNC210", "import requests\nasync def f():\n    requests.get(u)\n", "import requests\ndef f():\n    requests.get(u)\n"),
    ("ASYNC212", "import httpx\nasync def f():\n    httpx.get(u)\n", "import httpx\ndef f():\n    httpx.get(u)\n"),
    ("ASYNC220", "import subprocess\nasync def f():\n    subprocess.Popen(x)\n", "import subprocess\ndef f():\n    subprocess.Popen(x)\n"),
    ("ASYNC221", "import os\nasync def f():\n    os.system(x)\n", "import os\ndef f():\n    os.system(x)\n"),
    ("ASYNC222", "import os\nasync def f():\n    os.wait()\n", "import os\ndef f():\n    os.wait()\n"),
    ("ASYNC230", "async def f():\n    open(x)\n", "def f():\n    open(x)\n"),
    ("ASYNC250", "async def f():\n    input(x)\n", "def f():\n    input(x)\n"),
    ("ASYNC251", "import time\nasync def f():\n    time.sleep({k})\n", "import time\ndef f():\n    time.sleep({k})\n"),
    # comprehensions
    ("C400", "list(x for x in y)\n", "list(y)\n"),
    ("C401", "set(x for x in y)\n", "set(y)\n"),
    ("C402", "dict((x, {k}) for x in y)\n", "dict(y)\n"),
    ("C403", "set([x for x in y])\n", "set(y)\n"),
    ("C404", "dict([(x, {k}) for x in y])\n", "dict(y)\n"),
    ("C405", "set([{k}])\n", "set(x)\n"),
    ("C406", "dict([(1, {k})])\n", "dict(x)\n"),
    ("C408", "x = dict()\n", "x = dict(y)\n"),
    ("C409", "tuple([{k}])\n", "tuple(x)\n"),
    ("C410", "list([{k}])\n", "list(x)\n"),
    ("C411", "list([x for x in y])\n", "list(y)\n"),
    ("C413", "list(sorted(x))\n", "sorted(x)\n"),
    ("C414", "set(list(x))\n", "set(x)\n"),
    ("C415", "set(x[::-1])\n", "set(x[1:])\n"),
    ("C416", "x = [i for i in y]\n", "x = [i + 1 for i in y]\n"),
    ("C417", "map(lambda x: x + {k}, y)\n", "map(f, y)\n"),
    ("C418", "dict({'a': {k}})\n", "dict(a={k})\n"),
    ("C419", "any([x for x in y])\n", "any(x for x in y)\n"),
    # docstrings
    ("D100", "x = {k}\n", "'''Module.'''\nx = {k}\n"),
    ("D101", "class A:\n    x = {k}\n", "class A:\n    '''Class.'''\n    x = {k}\n"),
    ("D102", "class A:\n    def f(self):\n        return {k}\n", "class A:\n    def f(self):\n        '''F.'''\n        return {k}\n"),
    ("D103", "def f():\n    return {k}\n", "def f():\n    '''F.'''\n    return {k}\n"),
    ("D105", "class A:\n    def __str__(self):\n        return 'a{k}'\n", "class A:\n    def __str__(self):\n        '''S.'''\n        return 'a{k}'\n"),
    ("D107", "class A:\n    def __init__(self):\n        self.x = {k}\n", "class A:\n    def __init__(self):\n        '''S.'''\n        self.x = {k}\n"),
    ("D200", "def f():\n    '''\n    Text {k}.\n    '''\n", "def f():\n    '''Text {k}.'''\n"),
    ("D205", "def f():\n    '''Text {k}.\n    More.\n    '''\n", "def f():\n    '''Text {k}.\n\n    More.\n    '''\n"),
    ("D209", "def f():\n    '''Text {k}.\n\n    More.'''\n", "def f():\n    '''Text {k}.\n\n    More.\n    '''\n"),
    ("D210", "def f():\n    ''' Text {k}.'''\n", "def f():\n    '''Text {k}.'''\n"),
    ("D400", "def f():\n    '''Text {k}'''\n", "def f():\n    '''Text {k}.'''\n"),
    ("D402", "def f():\n    '''f({k}) is called.'''\n", "def f():\n    '''Is called.'''\n"),
    ("D403", "def f():\n    '''text {k}.'''\n", "def f():\n    '''Text {k}.'''\n"),
    ("D404", "def f():\n    '''This is {k}.'''\n", "def f():\n    '''Text {k}.'''\n"),
    ("D415", "def f():\n    '''Text {k}'''\n", "def f():\n    '''Text {k}!'''\n"),
    ("D419", "def f():\n    ''' '''\n    return {k}\n", "def f():\n    '''Text.'''\n    return {k}\n"),
    # dates
    ("DTZ001", "import datetime\ndatetime.datetime(2000, 1, 1)\n", "import datetime\ndatetime.datetime(2000, 1, 1, tzinfo=z)\n"),
    ("DTZ002", "import datetime\ndatetime.datetime.today()\n", "import datetime\ndatetime.datetime.now(z)\n"),
    ("DTZ003", "import datetime\ndatetime.datetime.utcnow()\n", "import datetime\ndatetime.datetime.now(z)\n"),
    ("DTZ004", "import datetime\ndatetime.datetime.utcfromtimestamp({k})\n", "import datetime\ndatetime.datetime.fromtimestamp({k}, z)\n"),
    ("DTZ005", "import datetime\ndatetime.datetime.now()\n", "import datetime\ndatetime.datetime.now(tz=z)\n"),
    ("DTZ006", "import datetime\ndatetime.datetime.fromtimestamp({k})\n", "import datetime\ndatetime.datetime.fromtimestamp({k}, tz=z)\n"),
    ("DTZ007", "import datetime\ndatetime.datetime.strptime(x, '%Y')\n", "import datetime\ndatetime.datetime.strptime(x, '%Y %z')\n"),
    ("DTZ011", "import datetime\ndatetime.date.today()\n", "import datetime\ndatetime.date(2000, 1, 1)\n"),
    ("DTZ012", "import datetime\ndatetime.date.fromtimestamp({k})\n", "import datetime\ndatetime.date(2000, 1, 1)\n"),
    ("DTZ901", "import datetime\nx = datetime.datetime.min\n", "import datetime\nx = datetime.datetime\n"),
    # annotations, flags, imports
    ("FA100", "import typing\nx: typing.Optional[int] = {k}\n", "from __future__ import annotations\nimport typing\nx: typing.Optional[int] = {k}\n"),
    ("FA102", "x: int | None = {k}\n", "from __future__ import annotations\nx: int | None = {k}\n"),
    ("FBT001", "def f(x: bool):\n    return {k}\n", "def f(*, x: bool):\n    return {k}\n"),
    ("FBT002", "def f(x=True):\n    return {k}\n", "def f(*, x=True):\n    return {k}\n"),
    ("FBT003", "f(True)\n", "f(x=True)\n"),
    ("FIX001", "# FIXME {k}\n", "# fix {k}\n"),
    ("FIX002", "# TODO {k}\n", "# to do {k}\n"),
    ("FIX003", "# XXX {k}\n", "# xx {k}\n"),
    ("FIX004", "# HACK {k}\n", "# hacked {k}\n"),
    ("FLY002", "','.join(['a', x])\n", "','.join(x)\n"),
    ("ICN001", "import numpy as nump\n", "import numpy as np\n"),
    ("INT001", "_(f'a{x}')\n", "_('a')\n"),
    ("INT002", "_('a'.format({k}))\n", "_('a').format({k})\n"),
    ("INT003", "_('a %s' % {k})\n", "_('a %s') % {k}\n"),
    ("I001", "import b{k}\nimport a\n", "import a\nimport b{k}\n"),
    ("ISC001", "x = 'a' 'b{k}'\n", "x = 'ab{k}'\n"),
    ("ISC002", "x = 'a' \\\n    'b{k}'\n", "x = ('a'\n    'b{k}')\n"),
    ("ISC003", "x = 'a' + 'b{k}'\n", "x = 'a' + y\n"),
    ("LOG001", "import logging\nlogging.Logger('a{k}')\n", "import logging\nlogging.getLogger('a{k}')\n"),
    ("LOG002", "import logging\nlogging.getLogger(__file__)\n", "import logging\nlogging.getLogger(__name__)\n"),
    ("LOG004", "logger.exception('a{k}')\n", "try:\n    f()\nexcept ValueError:\n    logger.exception('a{k}')\n"),
    ("LOG007", "logger.exception('a{k}', exc_info=False)\n", "logger.exception('a{k}', exc_info=True)\n"),
    ("LOG009", "import logging\nx = logging.WARN\n", "import logging\nx = logging.WARNING\n"),
    ("LOG014", "logger.info('a{k}', exc_info=True)\n", "try:\n    f()\nexcept ValueError:\n    logger.info('a{k}', exc_info=True)\n"),
    ("LOG015", "import logging\nlogging.info('a{k}')\n", "logger.info('a{k}')\n"),
    ("N801", "class a_b:\n    x = {k}\n", "class AB:\n    x = {k}\n"),
    ("N802", "def aB():\n    return {k}\n", "def a_b():\n    return {k}\n"),
    ("N803", "def f(aB):\n    return {k}\n", "def f(a_b):\n    return {k}\n"),
    ("N804", "class A:\n    @classmethod\n    def f(x):\n        return {k}\n", "class A:\n    @classmethod\n    def f(cls):\n        return {k}\n"),
    ("N805", "class A:\n    def f(x):\n        return {k}\n", "class A:\n    def f(self):\n        return {k}\n"),
    ("N806", "def f():\n    aB = {k}\n    return aB\n", "def f():\n    a_b = {k}\n    return a_b\n"),
    ("N807", "def __f__():\n    return {k}\n", "def f():\n    return {k}\n"),
    ("N811", "from a import ABC as abc\n", "from a import ABC as DEF\n"),
    ("N812", "from a import abc as Abc\n", "from a import abc as d\n"),
    ("N813", "from a import Abc as abc\n", "from a import Abc as Def\n"),
    ("N814", "from a import Abcd as ABCD\n", "from a import Abcd as Def\n"),
    ("N815", "class A:\n    aB = {k}\n", "class A:\n    a_b = {k}\n"),
    ("N816", "aB = {k}\n", "a_b = {k}\n"),
    ("N817", "from a import AbCd as AC\n", "from a import AbCd as Abc\n"),
    ("N818", "class A(Exception):\n    x = {k}\n", "class AError(Exception):\n    x = {k}\n"),
    ("NPY001", "import numpy as np\nx = np.int\n", "import numpy as np\nx = np.int64\n"),
    ("NPY002", "import numpy as np\nnp.random.rand({k})\n", "import numpy as np\nnp.random.default_rng({k})\n"),
    ("NPY003", "import numpy as np\nnp.product(x)\n", "import numpy as np\nnp.prod(x)\n"),
    ("PD002", "x.drop(inplace=True)\n", "x.drop(inplace=False)\n"),
    ("PD003", "x.isnull()\n", "x.isna()\n"),
    ("PD004", "x.notnull()\n", "x.notna()\n"),
    ("PD007", "x.ix[{k}]\n", "x.loc[{k}]\n"),
    ("PD008", "x.at[{k}]\n", "x.loc[{k}]\n"),
    ("PD009", "x.iat[{k}]\n", "x.iloc[{k}]\n"),
    ("PD010", "x.unstack()\n", "x.pivot_table()\n"),
    ("PD011", "y = my_df.values\n", "y = my_df.to_numpy()\n"),
    ("PD012", "import pandas as pd\npd.read_table(x)\n", "import pandas as pd\npd.read_csv(x)\n"),
    ("PD013", "x.stack()\n", "x.melt()\n"),
    ("PD015", "import pandas as pd\npd.merge(x, y)\n", "x.merge(y)\n"),
    ("PD101", "y = x.nunique() == 1\n", "y = x.nunique() == {k}00\n"),
    ("PERF101", "for x in list(y):\n    print(x)\n", "for x in y:\n    print(x)\n"),
    ("PERF102", "for _, x in y.items():\n    print(x)\n", "for x in y.values():\n    print(x)\n"),
    ("PERF203", "for x in y:\n    try:\n        f(x)\n    except ValueError:\n        g()\n", "try:\n    for x in y:\n        f(x)\nexcept ValueError:\n    g()\n"),
    ("PERF402", "for x in y:\n    z.append(x)\n", "for x in y:\n    z.append(x + 1)\n"),
    ("PGH003", "x = y  # type: ignore\n", "x = y  # type: ignore[a]\n"),
    ("PGH005", "m.called_once_with({k})\n", "m.assert_called_once_with({k})\n"),
    ("PIE790", "def f():\n    '''D.'''\n    pass\n", "def f():\n    pass\n"),
    ("PIE794", "class A:\n    x = 1\n    x = {k}\n", "class A:\n    x = 1\n    y = {k}\n"),
    ("PIE800", "x = {**{'a': {k}}}\n", "x = {**y}\n"),
    ("PIE804", "f(**{'a': {k}})\n", "f(a={k})\n"),
    ("PIE807", "x = lambda: []\n", "x = list\n"),
    ("PIE808", "range(0, {k})\n", "range({k})\n"),
    ("PIE810", "x.startswith('a') or x.startswith('b{k}')\n", "x.startswith(('a', 'b{k}'))\n"),
    # pylint
    ("PLC0105", "from typing import TypeVar\nT = TypeVar('T', covariant=True)\n", "from typing import TypeVar\nT_co = TypeVar('T_co', covariant=True)\n"),
    ("PLC0131", "from typing import TypeVar\nT = TypeVar('T', covariant=True, contravariant=True)\n", "from typing import TypeVar\nT = TypeVar('T', covariant=True)\n"),
    ("PLC0132", "from typing import TypeVar\nT = TypeVar('S')\n", "from typing import TypeVar\nT = TypeVar('T')\n"),
    ("PLC0205", "class A:\n    __slots__ = 'a{k}'\n", "class A:\n    __slots__ = ('a{k}',)\n"),
    ("PLC0207", "x = y.split(',')[0]\n", "x = y.split(',', maxsplit=1)[0]\n"),
    ("PLC0208", "for x in {1, {k}}:\n    print(x)\n", "for x in (1, {k}):\n    print(x)\n"),
    ("PLC0414", "import a as a\n", "import a as b\n"),
    ("PLC0415", "def f():\n    import os\n", "import os\n"),
    ("PLC1802", "if len(x):\n    y = {k}\n", "if x:\n    y = {k}\n"),
    ("PLC1901", "if x == '':\n    y = {k}\n", "if not x:\n    y = {k}\n"),
    ("PLC2401", "\u00e9 = {k}\n", "e = {k}\n"),
    ("PLC2403", "import \u00e9\n", "import e\n"),
    ("PLC2701", "from a import _b\n", "from a import b\n"),
    ("PLC3002", "(lambda x: x)({k})\n", "f({k})\n"),
    ("PLE0100", "class A:\n    def __init__(self):\n        yield {k}\n", "class A:\n    def f(self):\n        yield {k}\n"),
    ("PLE0101", "class A:\n    def __init__(self):\n        return {k}\n", "class A:\n    def __init__(self):\n        return\n"),
    ("PLE0115", "def f():\n    global x{k}\n    nonlocal x{k}\n", "def f():\n    global x{k}\n    nonlocal y{k}\n"),
    ("PLE0116", "while x:\n    try:\n        f()\n    finally:\n        continue\n", "while x:\n    try:\n        f()\n    finally:\n        g()\n"),
    ("PLE0117", "nonlocal x\n", "def f():\n    nonlocal x\n"),
    ("PLE0241", "class A(B, B):\n    x = {k}\n", "class A(B, C):\n    x = {k}\n"),
    ("PLE0302", "class A:\n    def __str__(self, x):\n        return 'a'\n", "class A:\n    def __str__(self):\n        return 'a'\n"),
    ("PLE0303", "class A:\n    def __len__(self):\n        return 'a{k}'\n", "class A:\n    def __len__(self):\n        return {k}\n"),
    ("PLE0304", "class A:\n    def __bool__(self):\n        return {k}\n", "class A:\n    def __bool__(self):\n        return True\n"),
    ("PLE0305", "class A:\n    def __index__(self):\n        return 'a{k}'\n", "class A:\n    def __index__(self):\n        return {k}\n"),
    ("PLE0307", "class A:\n    def __str__(self):\n        return {k}\n", "class A:\n    def __str__(self):\n        return 'a{k}'\n"),
    ("PLE0308", "class A:\n    def __bytes__(self):\n        return 'a{k}'\n", "class A:\n    def __bytes__(self):\n        return b'a{k}'\n"),
    ("PLE0309", "class A:\n    def __hash__(self):\n        return 'a{k}'\n", "class A:\n    def __hash__(self):\n        return {k}\n"),
    ("PLE0604", "__all__ = [x]\n", "__all__ = ['x']\nx = 1\n"),
    ("PLE0605", "__all__ = {k}\n", "__all__ = ()\n"),
    ("PLE0643", "x = [1, 2][3]\n", "x = [1, 2][1]\n"),
    ("PLE0704", "raise\n", "try:\n    f()\nexcept ValueError:\n    raise\n"),
    ("PLE1142", "def f():\n    await g({k})\n", "async def f():\n    await g({k})\n"),
    ("PLE1205", "logger.info('a', {k})\n", "logger.info('a %s', {k})\n"),
    ("PLE1206", "logger.info('a %s %s', {k})\n", "logger.info('a %s', {k})\n"),
    ("PLE1300", "x = '%y' % {k}\n", "x = '%d' % {k}\n"),
    ("PLE1307", "x = '%d' % 'a{k}'\n", "x = '%d' % {k}\n"),
    ("PLE1310", "x.strip('aab')\n", "x.strip('ab')\n"),
    ("PLE1507", "import os\nos.getenv({k})\n", "import os\nos.getenv('A{k}')\n"),
    ("PLE1519", "class A:\n    @singledispatch\n    def f(self):\n        return {k}\n", "@singledispatch\ndef f(x):\n    return {k}\n"),
    ("PLE1520", "@singledispatchmethod\ndef f(x):\n    return {k}\n", "class A:\n    @singledispatchmethod\n    def f(self):\n        return {k}\n"),
    ("PLE1700", "async def f():\n    yield from g({k})\n", "def f():\n    yield from g({k})\n"),
    ("PLR0124", "x == x\n", "x == y\n"),
    ("PLR0133", "1 == {k}\n", "x == {k}\n"),
    ("PLR0202", "class A:\n    def f(cls):\n        return {k}\n    f = classmethod(f)\n", "class A:\n    @classmethod\n    def f(cls):\n        return {k}\n"),
    ("PLR0203", "class A:\n    def f():\n        return {k}\n    f = staticmethod(f)\n", "class A:\n    @staticmethod\n    def f():\n        return {k}\n"),
    ("PLR0206", "class A:\n    @property\n    def f(self, x):\n        return {k}\n", "class A:\n    @property\n    def f(self):\n        return {k}\n"),
    ("PLR0402", "import a.b as b\n", "import a.b as c\n"),
    ("PLR0904", "class A:\n" + "".join(f"    def f{i}(self):\n        return {i}\n" for i in range(21)), "class A:\n    def f(self):\n        return {k}\n"),
    ("PLR0911", "def f(x):\n" + "".join(f"    if x == {i}:\n        return {i}\n" for i in range(8)), "def f(x):\n    return {k}\n"),
    ("PLR0912", "def f(x):\n" + "".join(f"    if x == {i}:\n        x = {i}\n" for i in range(14)), "def f(x):\n    return {k}\n"),
    ("PLR0913", "def f(a, b, c, d, e, g):\n    return {k}\n", "def f(a):\n    return {k}\n"),
    ("PLR0915", "def f(x):\n" + "    x = 1\n" * 52, "def f(x):\n    return {k}\n"),
    ("PLR0916", "if a and b and c and d and e and f:\n    g({k})\n", "if a and b:\n    g({k})\n"),
    ("PLR0917", "def f(a, b, c, d, e, g):\n    return {k}\n", "def f(a, b, *, c, d, e, g):\n    return {k}\n"),
    ("PLR1704", "def f(x):\n    for x in y:\n        print(x, {k})\n", "def f(x):\n    for z in y:\n        print(x, z, {k})\n"),
    ("PLR1711", "def f():\n    g({k})\n    return\n", "def f():\n    g({k})\n"),
    ("PLR1714", "x == 1 or x == {k}\n", "x in (1, {k})\n"),
    ("PLR1716", "a < b and b < c\n", "a < b < c\n"),
    ("PLR1722", "exit({k})\n", "import sys\nsys.exit({k})\n"),
    ("PLR1730", "if a < b:\n    a = b\n", "a = max(a, b)\n"),
    ("PLR2004", "if x == 100{k}:\n    y = 1\n", "if x == 1:\n    y = 1\n"),
    ("PLR2044", "x = 1\n#\ny = {k}\n", "x = 1\n# a\ny = {k}\n"),
    ("PLR5501", "if x:\n    f()\nelse:\n    if y:\n        g({k})\n", "if x:\n    f()\nelif y:\n    g({k})\n"),
    ("PLR6104", "x = x + {k}\n", "x += {k}\n"),
    ("PLR6201", "x in (1, {k})\n", "x in {1, {k}}\n"),
    ("PLR6301", "class A:\n    def f(self):\n        return {k}\n", "class A:\n    def f(self):\n        return self\n"),
    ("PLW0101", "def f():\n    return 1\n    g({k})\n", "def f():\n    g({k})\n    return 1\n"),
    ("PLW0108", "x = lambda a: f(a)\n", "x = lambda a: f(a, {k})\n"),
    ("PLW0120", "for x in y:\n    f(x)\nelse:\n    g({k})\n", "for x in y:\n    break\nelse:\n    g({k})\n"),
    ("PLW0127", "x = x\n", "x = y\n"),
    ("PLW0128", "a, a = 1, {k}\n", "a, b = 1, {k}\n"),
    ("PLW0129", "assert 'a{k}'\n", "assert x\n"),
    ("PLW0131", "(x := {k})\n", "y = (x := {k})\n"),
    ("PLW0133", "ValueError('a{k}')\n", "raise ValueError('a{k}')\n"),
    ("PLW0177", "x == float('nan')\n", "x == float('1')\n"),
    ("PLW0211", "class A:\n    @staticmethod\n    def f(self):\n        return {k}\n", "class A:\n    @staticmethod\n    def f(x):\n        return {k}\n"),
    ("PLW0245", "class A(B):\n    def f(self):\n        super.f()\n", "class A(B):\n    def f(self):\n        super().f()\n"),
    ("PLW0602", "def f():\n    global x{k}\n    print(x{k})\n", "def f():\n    global x{k}\n    x{k} = 1\n"),
    ("PLW0603", "def f():\n    global x{k}\n    x{k} = 1\n", "def f():\n    x{k} = 1\n    print(x{k})\n"),
    ("PLW0604", "global x{k}\n", "x{k} = 1\n"),
    ("PLW0642", "class A:\n    def f(self):\n        self = {k}\n", "class A:\n    def f(self):\n        x = self\n        return x\n"),
    ("PLW0711", "try:\n    f()\nexcept ValueError or KeyError:\n    g({k})\n", "try:\n    f()\nexcept (ValueError, KeyError):\n    g({k})\n"),
    ("PLW1501", "open(x, 'rw')\n", "open(x, 'rb')\n"),
    ("PLW1507", "import copy\nimport os\ncopy.copy(os.environ)\n", "import os\nos.environ.copy()\n"),
    ("PLW1508", "import os\nos.getenv('A', {k})\n", "import os\nos.getenv('A', '{k}')\n"),
    ("PLW1509", "import subprocess\nsubprocess.Popen(x, preexec_fn=f)\n", "import subprocess\nsubprocess.Popen(x)\n"),
    ("PLW1510", "import subprocess\nsubprocess.run(x)\n", "import subprocess\nsubprocess.run(x, check=True)\n"),
    ("PLW1641", "class A:\n    def __eq__(self, x):\n        return True\n", "class A:\n    def __eq__(self, x):\n        return True\n    def __hash__(self):\n        return {k}\n"),
    ("PLW2101", "import threading\nwith threading.Lock():\n    f({k})\n", "with lock:\n    f({k})\n"),
    ("PLW3201", "class A:\n    def __strr__(self):\n        return {k}\n", "class A:\n    def __str__(self):\n        return 'a'\n"),
    ("PLW3301", "min(1, min(2, {k}))\n", "min(1, 2, {k})\n"),
    # tests
    ("PT001", "import pytest\n@pytest.fixture()\ndef f():\n    return {k}\n", "import pytest\n@pytest.fixture\ndef f():\n    return {k}\n"),
    ("PT008", "mock.patch('a', new=lambda x: {k})\n", "mock.patch('a', return_value={k})\n"),
    ("PT009", "self.assertEqual(x, {k})\n", "assert x == {k}\n"),
    ("PT010", "import pytest\nwith pytest.raises():\n    f({k})\n", "import pytest\nwith pytest.raises(KeyError):\n    f({k})\n"),
    ("PT011", "import pytest\nwith pytest.raises(ValueError):\n    f({k})\n", "import pytest\nwith pytest.raises(ValueError, match='a'):\n    f({k})\n"),
    ("PT012", "import pytest\nwith pytest.raises(KeyError):\n    f()\n    g({k})\n", "import pytest\nwith pytest.raises(KeyError):\n    f({k})\n"),
    ("PT013", "from pytest import fixture\n", "import pytest\n"),
    ("PT015", "assert False\n", "assert x\n"),
    ("PT016", "import pytest\npytest.fail()\n", "import pytest\npytest.fail('a{k}')\n"),
    ("PT018", "assert x and y\n", "assert x\nassert y\n"),
    ("PT023", "import pytest\n@pytest.mark.slow()\ndef test_a():\n    assert {k}\n", "import pytest\n@pytest.mark.slow\ndef test_a():\n    assert {k}\n"),
    ("PT026", "import pytest\n@pytest.mark.usefixtures()\ndef test_a():\n    assert {k}\n", "import pytest\n@pytest.mark.usefixtures('a')\ndef test_a():\n    assert {k}\n"),
    ("PT028", "def test_a(x={k}):\n    assert x\n", "def test_a(x):\n    assert x\n"),
    ("PT029", "import pytest\nwith pytest.warns():\n    f({k})\n", "import pytest\nwith pytest.warns(UserWarning):\n    f({k})\n"),
    ("PT030", "import pytest\nwith pytest.warns(UserWarning):\n    f({k})\n", "import pytest\nwith pytest.warns(UserWarning, match='a'):\n    f({k})\n"),
    ("PT031", "import pytest\nwith pytest.warns(A):\n    f()\n    g({k})\n", "import pytest\nwith pytest.warns(A):\n    f({k})\n"),
    # returns, raises, simplification
    ("RET501", "def f():\n    return None\n", "def f():\n    return {k}\n"),
    ("RET505", "def f(x):\n    if x:\n        return 1\n    else:\n        return {k}\n", "def f(x):\n    if x:\n        return 1\n    return {k}\n"),
    ("RET506", "if x:\n    raise y\nelse:\n    f({k})\n", "if x:\n    raise y\nf({k})\n"),
    ("RET507", "for x in y:\n    if x:\n        continue\n    else:\n        f({k})\n", "for x in y:\n    if x:\n        continue\n    f({k})\n"),
    ("RET508", "for x in y:\n    if x:\n        break\n    else:\n        f({k})\n", "for x in y:\n    if x:\n        break\n    f({k})\n"),
    ("RSE102", "raise ValueError()\n", "raise ValueError\n"),
    ("RUF005", "x = [1] + y\n", "x = [1, *y]\n"),
    ("RUF006", "import asyncio\nasyncio.create_task(f({k}))\n", "import asyncio\nt = asyncio.create_task(f({k}))\n"),
    ("RUF007", "zip(x, x[1:])\n", "zip(x, y[1:])\n"),
    ("RUF008", "from dataclasses import dataclass\n@dataclass\nclass A:\n    x: list = []\n", "class A:\n    x: list = []\n"),
    ("RUF009", "from dataclasses import dataclass\n@dataclass\nclass A:\n    x: int = f({k})\n", "from dataclasses import dataclass, field\n@dataclass\nclass A:\n    x: int = field(default={k})\n"),
    ("RUF010", "x = f'{str(y)}'\n", "x = f'{y!s}'\n"),
    ("RUF012", "class A:\n    x = []\n", "class A:\n    x = ()\n"),
    ("RUF013", "def f(x: int = None):\n    return {k}\n", "def f(x: int | None = None):\n    return {k}\n"),
    ("RUF015", "list(x)[0]\n", "next(iter(x))\n"),
    ("RUF016", "[1, {k}]['a']\n", "[1, {k}][0]\n"),
    ("RUF017", "sum(x, [])\n", "sum(x)\n"),
    ("RUF018", "assert (x := {k})\n", "assert x\n"),
    ("RUF019", "k in d and d[k]\n", "k in d and e[k]\n"),
    ("RUF020", "x: int | Never = {k}\n", "x: int | str = {k}\n"),
    ("RUF022", "__all__ = ['b', 'a']\na = b = 1\n", "__all__ = ['a', 'b']\na = b = 1\n"),
    ("RUF023", "class A:\n    __slots__ = ('b', 'a')\n", "class A:\n    __slots__ = ('a', 'b')\n"),
    ("RUF024", "dict.fromkeys(x, [])\n", "dict.fromkeys(x, {k})\n"),
    ("RUF026", "from collections import defaultdict\ndefaultdict(default_factory=int)\n", "from collections import defaultdict\ndefaultdict(int)\n"),
    ("RUF029", "async def f():\n    return {k}\n", "async def f():\n    await g({k})\n"),
    ("RUF030", "assert x, print('a{k}')\n", "assert x, 'a{k}'\n"),
    ("RUF032", "from decimal import Decimal\nDecimal(1.{k})\n", "from decimal import Decimal\nDecimal('1.{k}')\n"),
    ("RUF033", "class A:\n    def __post_init__(self, x={k}):\n        f(x)\n", "class A:\n    def __post_init__(self, x):\n        f(x)\n"),
    ("RUF034", "x = {k} if y else {k}\n", "x = 1 if y else 2\n"),
    ("RUF036", "x: None | int = {k}\n", "x: int | None = {k}\n"),
    ("RUF037", "from collections import deque\ndeque([])\n", "from collections import deque\ndeque()\n"),
    ("RUF038", "from typing import Literal\nx: Literal[True, False] = True\n", "from typing import Literal\nx: Literal[True] = True\n"),
    ("RUF040", "assert x, {k}\n", "assert x, 'a{k}'\n"),
    ("RUF041", "from typing import Literal\nx: Literal[Literal[{k}], 0] = 0\n", "from typing import Literal\nx: Literal[{k}, 0] = 0\n"),
    ("RUF046", "int(len(x))\n", "int(x)\n"),
    ("RUF047", "if x:\n    f({k})\nelse:\n    pass\n", "if x:\n    f({k})\n"),
    ("RUF048", "map(int, __version__.split('.'))\n", "map(int, x.split('.'))\n"),
    ("RUF049", "from dataclasses import dataclass\n@dataclass\nclass A(Enum):\n    x = {k}\n", "class A(Enum):\n    x = {k}\n"),
    ("RUF051", "if k in d:\n    del d[k]\n", "if k in d:\n    del e[k]\n"),
    ("RUF056", "if d.get('a', False):\n    x = {k}\n", "if d.get('a'):\n    x = {k}\n"),
    ("RUF057", "round({k})\n", "round(x)\n"),
    ("RUF058", "import itertools\nitertools.starmap(f, zip(a, b))\n", "map(f, a, b)\n"),
    ("RUF060", "x in []\n", "x in [{k}]\n"),
    # security
    ("S101", "assert x\n", "x = {k}\n"),
    ("S102", "exec(x)\n", "f(x)\n"),
    ("S103", "import os\nos.chmod(x, 0o777)\n", "import os\nos.chmod(x, 0o600)\n"),
    ("S104", "x = '0.0.0.0'\n", "x = '127.0.0.1'\n"),
    ("S105", "password = 'a{k}'\n", "passage = 'a{k}'\n"),
    ("S106", "f(password='a{k}')\n", "f(passage='a{k}')\n"),
    ("S107", "def f(password='a{k}'):\n    return 1\n", "def f(password=None):\n    return {k}\n"),
    ("S108", "x = '/tmp/a{k}'\n", "x = '/srv/a{k}'\n"),
    ("S110", "try:\n    f()\nexcept ValueError:\n    pass\n", "try:\n    f()\nexcept ValueError:\n    g({k})\n"),
    ("S112", "for x in y:\n    try:\n        f()\n    except ValueError:\n        continue\n", "for x in y:\n    try:\n        f()\n    except ValueError:\n        g({k})\n"),
    ("S113", "import requests\nrequests.get(u)\n", "import requests\nrequests.get(u, timeout={k})\n"),
    ("S201", "app.run(debug=True)\n", "app.run(debug=False)\n"),
    ("S202", "tar.extractall(x)\n", "tar.extract(x)\n"),
    ("S301", "import pickle\npickle.loads(x)\n", "import json\njson.loads(x)\n"),
    ("S306", "import tempfile\ntempfile.mktemp()\n", "import tempfile\ntempfile.mkstemp()\n"),
    ("S307", "eval(x)\n", "f(x)\n"),
    ("S308", "mark_safe(x)\n", "escape(x)\n"),
    ("S310", "import urllib.request\nurllib.request.urlopen(u)\n", "import urllib.parse\nurllib.parse.quote(u)\n"),
    ("S311", "import random\nrandom.random()\n", "import secrets\nsecrets.token_hex({k})\n"),
    ("S312", "import telnetlib\ntelnetlib.Telnet(h)\n", "f(h)\n"),
    ("S314", "import xml.etree.ElementTree as E\nE.parse(x)\n", "import defusedxml.ElementTree as E\nE.parse(x)\n"),
    ("S318", "import xml.dom.minidom\nxml.dom.minidom.parse(x)\n", "f(x)\n"),
    ("S321", "import ftplib\nftplib.FTP(x)\n", "f(x)\n"),
    ("S323", "import ssl\nssl._create_unverified_context()\n", "import ssl\nssl.create_default_context()\n"),
    ("S324", "import hashlib\nhashlib.md5(x)\n", "import hashlib\nhashlib.sha256(x)\n"),
    ("S401", "import telnetlib\n", "import socket\n"),
    ("S402", "import ftplib\n", "import socket\n"),
    ("S403", "import pickle\n", "import json\n"),
    ("S404", "import subprocess\n", "import socket\n"),
    ("S501", "import requests\nrequests.get(u, verify=False)\n", "import requests\nrequests.get(u, verify=True)\n"),
    ("S502", "import ssl\nssl.wrap_socket(ssl_version=ssl.PROTOCOL_SSLv3)\n", "import ssl\nssl.wrap_socket(ssl_version=ssl.PROTOCOL_TLSv1_2)\n"),
    ("S503", "import ssl\ndef f(v=ssl.PROTOCOL_SSLv2):\n    return v\n", "import ssl\ndef f(v=ssl.PROTOCOL_TLS):\n    return v\n"),
    ("S504", "import ssl\nssl.wrap_socket(x)\n", "import ssl\nssl.wrap_socket(x, ssl_version=y)\n"),
    ("S505", "from cryptography.hazmat.primitives.asymmetric import rsa\nrsa.generate_private_key(key_size=1024)\n", "from cryptography.hazmat.primitives.asymmetric import rsa\nrsa.generate_private_key(key_size=4096)\n"),
    ("S506", "import yaml\nyaml.load(x)\n", "import yaml\nyaml.load(x, Loader=yaml.SafeLoader)\n"),
    ("S507", "c.set_missing_host_key_policy(AutoAddPolicy)\n", "c.set_missing_host_key_policy(RejectPolicy)\n"),
    ("S508", "from pysnmp.hlapi import CommunityData\nCommunityData('p', mpModel=0)\n", "from pysnmp.hlapi import CommunityData\nCommunityData('p', mpModel=2)\n"),
    ("S509", "from pysnmp.hlapi import UsmUserData\nUsmUserData('a', 'b')\n", "from pysnmp.hlapi import UsmUserData\nUsmUserData('a', 'b', 'c')\n"),
    ("S601", "c.exec_command(x)\n", "c.command(x)\n"),
    ("S602", "import subprocess\nsubprocess.run(x, shell=True)\n", "import subprocess\nsubprocess.run(x)\n"),
    ("S603", "import subprocess\nsubprocess.run(x)\n", "import subprocess\nsubprocess.run(['/bin/ls'])\n"),
    ("S605", "import os\nos.system(x)\n", "f(x)\n"),
    ("S606", "import os\nos.execv(x, y)\n", "f(x)\n"),
    ("S607", "import subprocess\nsubprocess.run(['ls'])\n", "import subprocess\nsubprocess.run(['/bin/ls'])\n"),
    ("S608", "q = 'select a" + ", b" * 100 + " from t where x = ' + y\n", "q = 'a from t where x = ' + y\n"),
    ("S609", "import os\nos.system('chmod 600 *')\n", "import os\nos.system('chmod 600 a')\n"),
    ("S610", "A.objects.extra(where=[x])\n", "A.objects.filter(x)\n"),
    ("S611", "RawSQL(x)\n", "Sql(x)\n"),
    ("S612", "import logging.config\nlogging.config.listen({k})\n", "import logging.config\nlogging.config.listen({k}, verify=f)\n"),
    ("S701", "import jinja2\njinja2.Environment()\n", "import jinja2\njinja2.Environment(autoescape=True)\n"),
    ("S702", "import mako.template\nmako.template.Template(x)\n", "f(x)\n"),
    ("S704", "from markupsafe import Markup\nMarkup(x)\n", "from markupsafe import Markup\nMarkup('a{k}')\n"),
    ("SIM101", "isinstance(x, int) or isinstance(x, str)\n", "isinstance(x, (int, str))\n"),
    ("SIM102", "if x:\n    if y:\n        f({k})\n", "if x and y:\n    f({k})\n"),
    ("SIM103", "def f(x):\n    if x:\n        return True\n    else:\n        return False\n", "def f(x):\n    return bool(x)\n"),
    ("SIM105", "try:\n    f()\nexcept ValueError:\n    pass\n", "try:\n    f()\nexcept ValueError:\n    g({k})\n"),
    ("SIM107", "def f():\n    try:\n        g()\n    finally:\n        return {k}\n", "def f():\n    try:\n        g()\n    finally:\n        h({k})\n"),
    ("SIM108", "if x:\n    y = 1\nelse:\n    y = {k}\n", "y = 1 if x else {k}\n"),
    ("SIM112", "import os\nos.getenv('abc{k}')\n", "import os\nos.getenv('ABC{k}')\n"),
    ("SIM115", "f = open(x)\n", "with open(x) as f:\n    g({k})\n"),
    ("SIM117", "with x:\n    with y:\n        f({k})\n", "with x, y:\n    f({k})\n"),
    ("SIM118", "x in y.keys()\n", "x in y\n"),
    ("SIM201", "if not x == {k}:\n    f()\n", "if x != {k}:\n    f()\n"),
    ("SIM202", "if not x != {k}:\n    f()\n", "if x == {k}:\n    f()\n"),
    ("SIM208", "if not (not x):\n    f({k})\n", "if x:\n    f({k})\n"),
    ("SIM210", "x = True if y else False\n", "x = bool(y)\n"),
    ("SIM211", "x = False if y else True\n", "x = not y\n"),
    ("SIM212", "x = b if not a else a\n", "x = a if a else b\n"),
    ("SIM220", "x and not x\n", "x and not y\n"),
    ("SIM221", "x or not x\n", "x or not y\n"),
    ("SIM222", "x or True\n", "x or y\n"),
    ("SIM223", "x and False\n", "x and y\n"),
    ("SIM300", "{k} == x\n", "x == {k}\n"),
    ("SIM401", "if k in d:\n    v = d[k]\nelse:\n    v = {k}\n", "v = d.get(k, {k})\n"),
    ("SIM905", "'a b{k}'.split()\n", "x.split()\n"),
    ("SIM910", "d.get(k, None)\n", "d.get(k)\n"),
    ("SIM911", "zip(d.keys(), d.values())\n", "d.items()\n"),
    ("SLF001", "x._y\n", "self._y\n"),
    ("SLOT000", "class A(str):\n    x = {k}\n", "class A(str):\n    __slots__ = ()\n"),
    ("SLOT001", "class A(tuple):\n    x = {k}\n", "class A(tuple):\n    __slots__ = ()\n"),
    ("SLOT002", "from collections import namedtuple\nclass A(namedtuple('B', 'x')):\n    y = {k}\n", "from collections import namedtuple\nclass A(namedtuple('B', 'x')):\n    __slots__ = ()\n"),
    ("T100", "breakpoint()\n", "f({k})\n"),
    ("T201", "print({k})\n", "f({k})\n"),
    ("T203", "import pprint\npprint.pprint({k})\n", "f({k})\n"),
    ("TC005", "if TYPE_CHECKING:\n    pass\n", "if TYPE_CHECKING:\n    import os\n"),
    ("TC006", "from typing import cast\ncast(int, {k})\n", "from typing import cast\ncast('int', {k})\n"),
    ("TC010", "x: 'int' | None = {k}\n", "x: 'int | None' = {k}\n"),
    ("TID252", "from ..a import b\n", "from .a import b\n"),
    ("TRY002", "raise Exception('a{k}')\n", "raise ValueError('a{k}')\n"),
    ("TRY003", "raise ValueError('" + "a long message " * 8 + "')\n", "raise ValueError('a{k}')\n"),
    ("TRY004", "if not isinstance(x, int):\n    raise ValueError('a{k}')\n", "if not isinstance(x, int):\n    raise TypeError('a{k}')\n"),
    ("TRY201", "try:\n    f()\nexcept ValueError as e:\n    g({k})\n    raise e\n", "try:\n    f()\nexcept ValueError as e:\n    g({k})\n    raise\n"),
    ("TRY203", "try:\n    f({k})\nexcept ValueError:\n    raise\n", "try:\n    f()\nexcept ValueError:\n    g({k})\n    raise\n"),
    ("TRY300", "def f():\n    try:\n        g()\n        return {k}\n    except ValueError:\n        h()\n", "def f():\n    try:\n        g()\n    except ValueError:\n        h()\n    else:\n        return {k}\n"),
    ("TRY301", "try:\n    raise ValueError({k})\nexcept ValueError:\n    f()\n", "try:\n    f({k})\nexcept ValueError:\n    g()\n"),
    ("TRY400", "try:\n    f()\nexcept ValueError:\n    logger.error('a{k}')\n", "try:\n    f()\nexcept ValueError:\n    logger.exception('a{k}')\n"),
    ("TRY401", "try:\n    f()\nexcept ValueError as e:\n    logger.exception('a{k} %s', e)\n", "try:\n    f()\nexcept ValueError as e:\n    logger.exception('a{k}')\n"),
    # upgrades
    ("UP001", "class A:\n    __metaclass__ = type\n", "class A:\n    __metaclass__ = M\n"),
    ("UP003", "type('a{k}')\n", "type(x)\n"),
    ("UP004", "class A(object):\n    x = {k}\n", "class A:\n    x = {k}\n"),
    ("UP005", "self.assertEquals(x, {k})\n", "self.assertEqual(x, {k})\n"),
    ("UP006", "from typing import List\nx: List[int] = []\n", "x: list[int] = []\n"),
    ("UP007", "from typing import Union\nx: Union[int, str] = {k}\n", "x: int | str = {k}\n"),
    ("UP008", "class A(B):\n    def f(self):\n        super(A, self).f()\n", "class A(B):\n    def f(self):\n        super().f()\n"),
    ("UP009", "# -*- coding: utf-8 -*-\nx = {k}\n", "# -*- coding: latin-1 -*-\nx = {k}\n"),
    ("UP010", "from __future__ import print_function\n", "from __future__ import annotations\n"),
    ("UP011", "from functools import lru_cache\n@lru_cache()\ndef f():\n    return {k}\n", "from functools import lru_cache\n@lru_cache\ndef f():\n    return {k}\n"),
    ("UP014", "from typing import NamedTuple\nA = NamedTuple('A', [('x', int)])\n", "from typing import NamedTuple\nclass A(NamedTuple):\n    x: int\n"),
    ("UP015", "open(x, 'r')\n", "open(x)\n"),
    ("UP017", "import datetime\nx = datetime.timezone.utc\n", "import datetime\nx = datetime.UTC\n"),
    ("UP018", "str('a{k}')\n", "str(x)\n"),
    ("UP019", "import typing\nx: typing.Text = 'a{k}'\n", "x: str = 'a{k}'\n"),
    ("UP020", "import io\nio.open(x)\n", "open(x)\n"),
    ("UP021", "f(universal_newlines=True)\n", "f(text=True)\n"),
    ("UP022", "import subprocess\nsubprocess.run(x, stdout=subprocess.PIPE, stderr=subprocess.PIPE)\n", "import subprocess\nsubprocess.run(x, capture_output=True)\n"),
    ("UP023", "import xml.etree.cElementTree as E\n", "import xml.etree.ElementTree as E\n"),
    ("UP024", "try:\n    f()\nexcept IOError:\n    g({k})\n", "try:\n    f()\nexcept OSError:\n    g({k})\n"),
    ("UP025", "x = u'a{k}'\n", "x = 'a{k}'\n"),
    ("UP026", "import mock\n", "from unittest import mock\n"),
    ("UP028", "def f(y):\n    for x in y:\n        yield x\n", "def f(y):\n    yield from y\n"),
    ("UP029", "from builtins import str\n", "from a import str\n"),
    ("UP030", "'{0} {1}'.format(x, {k})\n", "'{} {}'.format(x, {k})\n"),
    ("UP032", "'{}'.format({k})\n", "f'{x}'\n"),
    ("UP033", "from functools import lru_cache\n@lru_cache(maxsize=None)\ndef f():\n    return {k}\n", "from functools import cache\n@cache\ndef f():\n    return {k}\n"),
    ("UP035", "from typing import List\n", "from typing import Any\n"),
    ("UP036", "import sys\nif sys.version_info >= (3, 6):\n    f({k})\n", "f({k})\n"),
    ("UP039", "class A():\n    x = {k}\n", "class A:\n    x = {k}\n"),
    ("UP040", "from typing import TypeAlias\nA: TypeAlias = int\n", "type A = int\n"),
    ("UP041", "import asyncio\ntry:\n    f()\nexcept asyncio.TimeoutError:\n    g({k})\n", "try:\n    f()\nexcept TimeoutError:\n    g({k})\n"),
    ("UP042", "from enum import Enum\nclass A(str, Enum):\n    x = 'a{k}'\n", "from enum import StrEnum\nclass A(StrEnum):\n    x = 'a{k}'\n"),
    ("UP043", "x: Generator[int, None, None] = f({k})\n", "x: Generator[int, str, None] | None = f({k})\n" if False else "x: Generator[int] = f({k})\n"),
    ("UP044", "x: Unpack[T] = f({k})\n", "x: T = f({k})\n"),
    ("UP046", "from typing import Generic\nclass A(Generic[T]):\n    x = {k}\n", "class A[T]:\n    x = {k}\n"),
    ("UP050", "class A(metaclass=type):\n    x = {k}\n", "class A(metaclass=M):\n    x = {k}\n"),
    # frameworks
    ("AIR001", "a = BashOperator(task_id='b{k}')\n", "a{k} = BashOperator(task_id='a{k}')\n"),
    ("AIR002", "from airflow import DAG\nDAG('a{k}')\n", "from airflow import DAG\nDAG('a{k}', schedule='@daily')\n"),
    ("DJ001", "class A(models.Model):\n    x = models.CharField(null=True)\n", "class A(models.Model):\n    x = models.CharField()\n"),
    ("DJ003", "render(r, 'a{k}', locals())\n", "render(r, 'a{k}', {})\n"),
    ("DJ006", "class F(forms.ModelForm):\n    class Meta:\n        exclude = ['a{k}']\n", "class F(forms.ModelForm):\n    class Meta:\n        fields = ['a{k}']\n"),
    ("DJ007", "class F(forms.ModelForm):\n    class Meta:\n        fields = '__all__'\n", "class F(forms.ModelForm):\n    class Meta:\n        fields = ['a{k}']\n"),
    ("DJ008", "class A(models.Model):\n    x = {k}\n", "class A(models.Model):\n    def __str__(self):\n        return 'a{k}'\n"),
    ("DJ013", "@a\n@receiver(x)\ndef f():\n    return {k}\n", "@receiver(x)\n@a\ndef f():\n    return {k}\n"),
    ("FAST001", "@app.get('/', response_model=A)\ndef f() -> A:\n    return {k}\n", "@app.get('/')\ndef f() -> A:\n    return {k}\n"),
    # refurbishment
    ("FURB101", "with open(x) as f:\n    y = f.read()\n", "with open(x) as f:\n    y = f.readline()\n"),
    ("FURB103", "with open(x, 'w') as f:\n    f.write(y)\n", "with open(x, 'w') as f:\n    f.flush()\n"),
    ("FURB105", "print('')\n", "print()\n"),
    ("FURB110", "x = a if a else {k}\n", "x = a or {k}\n"),
    ("FURB116", "x = bin({k})[2:]\n", "x = f'{y:b}'\n"),
    ("FURB122", "for x in y:\n    f.write(x)\n", "f.writelines(y)\n"),
    ("FURB129", "for x in f.readlines():\n    g(x)\n", "for x in f:\n    g(x)\n"),
    ("FURB131", "del x[:]\n", "x.clear()\n"),
    ("FURB132", "if x in y:\n    y.remove(x)\n", "y.discard(x)\n"),
    ("FURB136", "x = a if a > b else b\n", "x = max(a, b)\n"),
    ("FURB142", "for x in y:\n    z.add(x)\n", "z.update(y)\n"),
    ("FURB145", "x = y[:]\n", "x = y.copy()\n"),
    ("FURB148", "for _, x in enumerate(y):\n    f(x)\n", "for i, x in enumerate(y):\n    f(i, x)\n"),
    ("FURB152", "x = 3.14\n", "x = 3.2\n"),
    ("FURB154", "def f():\n    global x{k}\n    global y{k}\n", "def f():\n    global x{k}, y{k}\n"),
    ("FURB156", "x = '0123456789'\n", "x = '012345678{k}a'\n"),
    ("FURB157", "from decimal import Decimal\nDecimal('{k}')\n", "from decimal import Decimal\nDecimal({k})\n"),
    ("FURB161", "bin(x).count('1')\n", "x.bit_count()\n"),
    ("FURB162", "datetime.fromisoformat(x.replace('Z', '+00:00'))\n", "datetime.fromisoformat(x)\n"),
    ("FURB163", "import math\nmath.log(x, 2)\n", "import math\nmath.log2(x)\n"),
    ("FURB166", "int(x[2:], 16)\n", "int(x, 0)\n"),
    ("FURB167", "import re\nre.compile('a', re.I)\n", "import re\nre.compile('a', re.IGNORECASE)\n"),
    ("FURB168", "isinstance(x, type(None))\n", "x is None\n"),
    ("FURB169", "type(x) is type(None)\n", "x is None\n"),
    ("FURB171", "x in (1,)\n", "x in (1, {k})\n"),
    ("FURB177", "from pathlib import Path\nPath().resolve()\n", "from pathlib import Path\nPath.cwd()\n"),
    ("FURB180", "class A(metaclass=ABCMeta):\n    x = {k}\n", "class A(ABC):\n    x = {k}\n"),
    ("FURB181", "h.digest().hex()\n", "h.hexdigest()\n"),
    ("FURB187", "x = x[::-1]\n", "x.reverse()\n"),
    ("FURB189", "class A(dict):\n    x = {k}\n", "class A(UserDict):\n    x = {k}\n"),
    ("FURB192", "sorted(x)[0]\n", "min(x)\n"),
    # stubs
    ("PYI001", "T = TypeVar('T')\n", "_T = TypeVar('_T')\n"),
    ("PYI006", "import sys\nif sys.version_info > (3, 8):\n    x = {k}\n", "import sys\nif sys.version_info >= (3, 8):\n    x = {k}\n"),
    ("PYI007", "import sys\nif sys.platform < 'linux':\n    x: int\n", "import sys\nif sys.platform == 'linux':\n    x: int\n"),
    ("PYI008", "import sys\nif sys.platform == 'linus':\n    x: int\n", "import sys\nif sys.platform == 'linux':\n    x: int\n"),
    ("PYI009", "def f(): pass\n", "def f(): ...\n"),
    ("PYI010", "def f():\n    return {k}\n", "def f(): ...\n"),
    ("PYI012", "class A:\n    x: int\n    pass\n", "class A:\n    pass\n"),
    ("PYI013", "class A:\n    x: int\n    ...\n", "class A: ...\n"),
    ("PYI016", "x: int | int\n", "x: int | str\n"),
    ("PYI017", "a = b = int\n", "a = int\n"),
    ("PYI020", "def f(x: 'int'): ...\n", "def f(x: int): ...\n"),
    ("PYI021", "def f():\n    '''Doc {k}.'''\n", "def f(): ...\n"),
    ("PYI024", "import collections\nA = collections.namedtuple('A', 'x')\n", "from typing import NamedTuple\nclass A(NamedTuple):\n    x: int\n"),
    ("PYI025", "from collections.abc import Set\n", "from collections.abc import Set as AbstractSet\n"),
    ("PYI029", "class A:\n    def __str__(self) -> str: ...\n", "class A:\n    def f(self) -> str: ...\n"),
    ("PYI030", "x: Literal[1] | Literal[2]\n", "x: Literal[1, 2]\n"),
    ("PYI032", "class A:\n    def __eq__(self, x: Any): ...\n", "class A:\n    def __eq__(self, x: object): ...\n"),
    ("PYI033", "x = f()  # type: int\n", "x: int = f()\n"),
    ("PYI042", "my_alias: TypeAlias = int\n", "MyAlias: TypeAlias = int\n"),
    ("PYI043", "_MyT: TypeAlias = int\n", "_My: TypeAlias = int\n"),
    ("PYI044", "from __future__ import annotations\n", "import annotations\n"),
    ("PYI045", "class A:\n    def __iter__(self) -> Iterable[int]: ...\n", "class A:\n    def __iter__(self) -> Iterator[int]: ...\n"),
    ("PYI048", "def f():\n    x = 1\n    y = {k}\n", "def f(): ...\n"),
    ("PYI050", "def f(x: NoReturn): ...\n", "def f(x: Never): ...\n"),
    ("PYI051", "x: Literal['a'] | str\n", "x: Literal['a'] | int\n"),
    ("PYI053", "x: str = '" + "a" * 60 + "'\n", "x: str = 'a{k}'\n"),
    ("PYI054", "x: int = 12345678901\n", "x: int = {k}\n"),
    ("PYI055", "x: type[int] | type[str]\n", "x: type[int | str]\n"),
    ("PYI056", "__all__ = ['a']\n__all__.append('b{k}')\n", "__all__ = ['a']\n__all__ += ['b{k}']\n"),
    ("PYI057", "import typing\nx: typing.ByteString\n", "x: bytes\n"),
    ("PYI059", "class A(Generic[T], B): ...\n", "class A(B, Generic[T]): ...\n"),
    ("PYI062", "x: Literal[1, 2, 1]\n", "x: Literal[1, 2, 3]\n"),
    ("PYI063", "def f(__x: int): ...\n", "def f(x: int, /): ...\n"),
    ("PYI064", "x: Final[Literal[{k}]] = {k}\n", "x: Final = {k}\n"),
    # other families
    ("ANN001", "def f(x):\n    return {k}\n", "def f(x: int):\n    return {k}\n"),
    ("ANN201", "def f():\n    return {k}\n", "def f() -> int:\n    return {k}\n"),
    ("ANN202", "def _f():\n    return {k}\n", "def _f() -> int:\n    return {k}\n"),
    ("ANN204", "class A:\n    def __str__(self):\n        return 'a'\n", "class A:\n    def __str__(self) -> str:\n        return 'a'\n"),
    ("ARG001", "def f(x):\n    return g({k})\n", "def f(x):\n    return g(x, {k})\n"),
    ("C901", "def f(x):\n" + "".join(f"    if x == {i}:\n        x = {i}\n" for i in range(12)), "def f(x):\n    return {k}\n"),
    ("COM818", "x = {k},\n", "x = ({k},)\n"),
    ("CPY001", "x = {k}\n", "# Copyright 2024 A\nx = {k}\n"),
    ("EM101", "raise ValueError('a{k}')\n", "m = 'a{k}'\nraise ValueError(m)\n"),
    ("EM102", "raise ValueError(f'a{x}')\n", "raise ValueError(m)\n"),
    ("EM103", "raise ValueError('a{}'.format({k}))\n", "raise ValueError(m)\n"),
    ("ERA001", "# x = f(1)\ny = {k}\n", "# A remark.\ny = {k}\n"),
    ("EXE003", "#!/bin/sh\nx = {k}\n", "#!/usr/bin/env python3\nx = {k}\n"),
    ("EXE004", " #!/usr/bin/env python3\nx = {k}\n", "#!/usr/bin/env python3\nx = {k}\n"),
    ("EXE005", "x = {k}\n#!/usr/bin/env python3\n", "#!/usr/bin/env python3\nx = {k}\n"),
    ("G001", "logger.info('{}'.format({k}))\n", "logger.info('%s', {k})\n"),
    ("G002", "logger.info('%s' % {k})\n", "logger.info('%s', {k})\n"),
    ("G004", "logger.info(f'{x}')\n", "logger.info('%s', x)\n"),
    ("G010", "logger.warn('a{k}')\n", "logger.warning('a{k}')\n"),
    ("Q000", "x = 'a{k}'\n", "x = \"a{k}\"\n"),
    ("TD002", "# TODO: a{k}\n", "# TODO(me): a{k}\n"),
    ("YTT101", "import sys\nx = sys.version[:3]\n", "import sys\nx = sys.version_info[:3]\n"),
    ("YTT201", "import sys\nx = sys.version_info[0] == 3\n", "import sys\nx = sys.version_info[0] >= 3\n"),
    *[(f"PTH{n}", f"import {call.rsplit('.', 1)[0]}\n{call}(x)\n", "import pathlib\npathlib.Path(x)\n") for n, call in [
        (100, "os.path.abspath"), (101, "os.chmod"), (102, "os.mkdir"), (103, "os.makedirs"), (104, "os.rename"), (105, "os.replace"), (106, "os.rmdir"), (107, "os.remove"),
        (108, "os.unlink"), (109, "os.getcwd"), (110, "os.path.exists"), (111, "os.path.expanduser"), (112, "os.path.isdir"), (113, "os.path.isfile"), (114, "os.path.islink"),
        (115, "os.readlink"), (116, "os.stat"), (117, "os.path.isabs"), (118, "os.path.join"), (119, "os.path.basename"), (120, "os.path.dirname"), (121, "os.path.samefile"),
        (122, "os.path.splitext"), (202, "os.path.getsize"), (204, "os.path.getmtime"), (207, "glob.glob"), (208, "os.listdir"),
    ]],
    ("PTH123", "open(x)\n", "x.open()\n"),
]
