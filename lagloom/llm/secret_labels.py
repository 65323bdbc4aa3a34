"""Labelled findings to train the secret filter on: generated by rule.

Each row is a finding as a scanner would meet it: the value, the text before
it, the path it lies in and whether it is a secret. Values are drawn from
hashes of the row number, so the table is the same everywhere. Own labelled
findings of the same columns can be used in its place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_HEX = "sha2(concat('{salt}', cast(id AS string)), 256)"
_B64 = "base64(unhex(sha2(concat('{salt}', cast(id AS string)), 512)))"


def _pick(salt: str, *words: str) -> str:
    shown = ", ".join("'" + w.replace("'", "\\'") + "'" for w in words)
    return f"element_at(array({shown}), cast(1 + pmod(xxhash64(id, '{salt}'), {len(words)}) AS int))"


def _hex(salt: str, n: int) -> str:
    return f"substr({_HEX.format(salt=salt)}, 1, {n})"


def _b64(salt: str, n: int, drop: str = "[^A-Za-z0-9]") -> str:
    return f"substr(regexp_replace({_B64.format(salt=salt)}, '{drop}', ''), 1, {n})"


def _number(salt: str, lo: int, hi: int) -> str:
    return f"cast({lo} + pmod(xxhash64(id, '{salt}'), {hi - lo + 1}) AS string)"


_WORDS = ("about", "between", "chapter", "number", "other", "section", "which", "without")
_PLAIN = ("the ", "of the ", "and ", "tion. ", "is a ", ", ", "see ", "with ", "une ", "der ", "los ", "")
_PATH = ("src/app.py", "conf/prod.yml", "web", "docs", "lib/core.rs", "home", "deploy/main.tf", ".env")
_TEST = ("test/fixtures/auth.py", "examples/demo.js", "docs/sample.md", "package-lock.json", "lib/core.rs", "web")


def _kinds(words: Sequence[str]) -> list[tuple[str, str, str, int]]:
    """(value, text before, path, label) as SQL."""
    plain, path, test = _pick("l", *_PLAIN), _pick("p", *_PATH), _pick("t", *_TEST)
    assign = _pick("k", "password=", "passwd: ", "secret = ", "token = ", "api_key=", "auth_token: ", "client_secret=")
    any_case = _pick("E", "PASSWORD=", 'password = "', "Passwd: ", "SECRET : ", "apiKey=", '"token": "', "pwd=", "DB_PASSWORD = ")
    phrase = f"concat({_pick('E2', 'correct', 'purple', 'dragon', 'winter', 'monkey', 'silver')}, {_pick('E3', 'horse', 'tiger', 'castle', 'rocket', 'garden')}, {_pick('E4', '!', '#', '-', '', '')}, {_pick('E5', 'battery', 'staple', 'window', 'sunset', 'river')})"
    long = f"concat({_b64('J', 60)}, {_b64('J2', 60)})"
    word = _pick("w", "user", "order", "invoice", "build", "release", "section", "chapter", "figure", "item")
    return [
        (f"concat('AKIA', upper({_b64('a', 16, '[^A-Za-z2-7]')}))", plain, path, 1),
        (f"concat('password=', {_hex('b', 18)})", plain, path, 1),
        (_hex("c", 40), f"concat({plain}, 'token = \"')", path, 1),
        (_b64("d", 40, "[^A-Za-z0-9+/]"), f"concat({plain}, {assign})", path, 1),
        (f"concat('ghp_', {_b64('e', 36)})", plain, path, 1),
        (f"concat({_pick('m', 'sk_live_', 'xoxb-', 'glpat-', 'AIza', 'eyJ')}, {_b64('f', 32)})", plain, path, 1),
        (f"concat({_pick('n', 'password=', 'secret=', 'api_key=', 'token=')}, {_b64('g', 14, '[^A-Za-z0-9+/]')}, {_number('g2', 10, 99)})", plain, path, 1),
        (_b64("h", 24), f"concat({plain}, {assign}, '\"')", path, 1),
        (f"concat('eyJ', {long}, '.eyJ', {_b64('K', 60)}, {_b64('K2', 60)}, '.', {_b64('K3', 60)}, {_b64('K4', 60)})", plain, path, 1),
        (f"concat({long}, {_b64('L', 60)}, {_b64('L2', 60)}, {_b64('L3', 60)}, {_b64('L4', 60)})", f"concat({plain}, {_pick('L5', 'base64,', 'image ', 'data ', 'integrity ', '')})", path, 0),
        (f"concat('AKIA', upper({_b64('C', 16, '[^A-Za-z]')}))", plain, path, 1),
        (f"concat({_pick('D', 'ghp_', 'glpat-', 'sk_live_', 'gho_')}, {_b64('D2', 24, '[^A-Za-z]')})", plain, path, 1),
        (phrase, f"concat({plain}, {any_case})", path, 1),
        (f"concat({_b64('F', 12, '[^A-Za-z]')}, {_pick('F2', '!', '#', '$', '%', '', '')}, {_b64('F3', 6, '[^A-Za-z]')})", f"concat({plain}, {any_case})", path, 1),
        (f"concat({_pick('I', 'hunter', 'Dragon', 'tr0ub', 'Summer', 'Qw', 'zebra')}, {_number('I2', 1, 2030)}, {_pick('I3', '!', '#', '$', '@', '')}, {_b64('I4', 5)}, {_pick('I5', '!', '#q', '', ' Zx')})", f"concat({plain}, {any_case})", path, 1),
        (f"concat({_pick('G', 'please', 'required', 'incorrect', 'between ', 'undefined', 'getToken()', 'request.form', 'os.environ', 'optional,', 'internal', 'whatever', 'nothing')}, {_pick('G2', '', '', '.', ' and the other', ';')})", f"concat({plain}, {any_case})", path, 0),
        (f"concat({_pick('H', 'Please', 'Enter', 'Your', 'Choose', 'Forgot')}, {_pick('H2', ' your password', ' a new value', ' the name', ' it here')})", f"concat({plain}, {any_case})", path, 0),
        (f"concat({_pick('q', 'anna', 'jo', 'info', 'kp', 'lenn')}, '.', {_number('i', 10, 99)}, '@mail', {_number('i2', 0, 9)}, '.example.com')", plain, path, 0),
        (f"concat({_number('j', 200, 999)}, '-', {_number('j2', 1000, 9999)})", f"concat({plain}, {_pick('j3', 'phone ', 'tel. ', '+1 (689) ', 'call ')})", path, 0),
        (f"concat('4', {_number('o', 10000000, 99999999)}, {_number('o2', 1000000, 9999999)})", f"concat({plain}, {_pick('o3', 'card ', 'order ', 'isbn ', '')})", path, 0),
        (f"concat({_number('r', 1, 255)}, '.', {_number('r2', 0, 255)}, '.', {_number('r3', 0, 255)}, '.', {_number('r4', 0, 255)})", plain, path, 0),
        (f"substr({_HEX.format(salt='s')}, 1, {_pick('s2', '32', '40', '64')})", f"concat({plain}, {_pick('s3', 'commit ', 'sha256 ', 'checksum: ', 'md5 = ', 'etag ', 'integrity ')})", test, 0),
        (f"concat_ws('-', {_hex('u', 8)}, {_hex('u2', 4)}, {_hex('u3', 4)}, {_hex('u4', 4)}, {_hex('u5', 12)})", f"concat({plain}, {_pick('u6', 'request id ', 'uuid ', 'trace ', 'id=')})", path, 0),
        (f"concat({_pick('v', 'password=changeme', 'password=example', 'token=your-token-here', 'api_key=xxxxxxxxxxxx', 'secret=placeholder', 'password=testpassword', 'AKIAEXAMPLEEXAMPLE', 'token=dummytoken')}, {_number('v2', 1, 999)})", plain, test, 0),
        (f"concat({word}, {_pick('x', '-', '_', '.')}, {_pick('x2', 'version', 'number', 'release', 'update')}, {_pick('x3', '-', '_', '.')}, {_number('x4', 1, 2030)})", plain, path, 0),
        (f"concat({_pick('y', 'get', 'load', 'make', 'find')}, initcap({word}), {_pick('y2', 'ById', 'Table', 'Handler', 'Section')}, {_number('y3', 1, 64)})", plain, path, 0),
        (f"concat({_number('z', 1990, 2030)}, '-0', {_number('z2', 1, 9)}, '-', {_number('z3', 10, 28)}, {_pick('z4', '', '/report', '.html', '/page1')})", plain, path, 0),
        (f"concat('www.example', {_number('A', 1, 99)}, '.com/', {word}, '/', {_number('A2', 1, 9999)})", f"concat({plain}, {_pick('A3', 'https://', 'see ', '')})", path, 0),
        (f"concat({_pick('B', *words)}, {_number('B3', 1, 99)}, {_pick('B4', *words)})", plain, path, 0),
    ]


def labelled_findings(spark: SparkSession, rows: int = 6000, words: Sequence[str] = ()) -> DataFrame:
    """value, before, path, label; words are those that plain runs are made of."""
    kinds = _kinds(words or _WORDS)
    columns = []
    for k, name in enumerate(("value", "before", "path", "label")):
        cases = " ".join(f"WHEN {i} THEN {kind[k]}" for i, kind in enumerate(kinds))
        columns.append(f"CASE pmod(id, {len(kinds)}) {cases} END AS {name}")
    return spark.range(rows).selectExpr(*columns)
