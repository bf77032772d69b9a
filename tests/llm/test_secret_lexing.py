"""Assignment-aware lexing: forms of source and configuration, scopes, and texts without secrets."""

import time

import pytest

from tessella.llm.secrets import find_secrets

FORMS = [
    'db_pwd: str = "Zx9!qwerty"',
    'const dbPwd: string = "Zx9!qwerty";',
    'var dbPwd string = "Zx9!qwerty"',
    'let db_pwd: &str = "Zx9!qwerty";',
    'os.environ["DB_PASSPHRASE"] = "Zx9!qwerty"',
    'config["pwd"] = "Zx9!qwerty"',
    '<add key="DbPwd" value="Zx9!qwerty"/>',
    '#define DB_PWD "Zx9!qwerty"',
    'pwd = """Zx9!qwerty"""',
    'String dbPwd = "Zx9!qwerty";',
    'static const char db_pwd[] = "Zx9!qwerty";',
    '{"pwd": "Zx9!qwerty"}',
    'pwd: Zx9!qwerty',
    'DB_PWD=Zx9!qwerty',
    'tool --pwd=Zx9!qwerty run',
    '<pwd> Zx9!qwerty </pwd>',
    ':pwd => "Zx9!qwerty"',
    'ENV DB_PWD Zx9!qwerty',
    'connect(user="me", pwd="Zx9!qwerty")',
    'pwd:string="Zx9!qwerty"',
    "x = 'it'; don't pwd = 'Zx9!qwerty'",
    'class A { private final String pwd = "Zx9!qwerty"; }',
    'pwd := "Zx9!qwerty"',
    'K = "Zx9!qwerty"\ndb_pwd = K',
    'A="Zx9!"\nB="qwerty"\nurl_pwd = f"{A}{B}"',
    'export PW_PART="Zx9!qwerty"\nDB_PWD="$PW_PART"',
    'let a = "Zx9!qwerty"; let cfg = { pwd: a };',
]
NONE = [
    'pwd_help: "Enter your password here1"',
    'The password: is what you type. Note: see token = usage',
    'pwd = getpass("Enter Password1: ")',
    'password_field = "user_Password1"',
    'if pwd == "Zx9!qwerty": pass',
    'pwd: str\nname = "Zx9!qwerty"',
    'K = "Zx9!qwerty"\ndef f():\n    K = open(1)\n    db_pwd = K\n',
    'function f() { const K = "Zx9!qwerty"; }\nconst db_pwd = K;',
    'K="Zx9!qwerty"\nK = read()\ndb_pwd = K',
    'see https://x.org/pwd:80/Zx9',
    'auth = self.auth.token.value',
]


def added(text):
    return [(k, text[s:e]) for k, s, e in find_secrets(text) if k in ("named", "flow")]


@pytest.mark.parametrize("text", FORMS)
def test_each_form_is_read(text):
    assert "".join(x for _, x in added(text)) == "Zx9!qwerty"


@pytest.mark.parametrize("text", NONE)
def test_what_holds_no_secret(text):
    assert not added(text)


def test_spans_lie_outside_those_of_the_base():
    text = 'part = "Zx9!qwerty"\ndb_pwd = part\nsigning_passphrase = "correct horse battery 9"\npassword=hunter2hunter2'
    base = {(s, e) for k, s, e in find_secrets(text) if k == "assign"}
    more = {(k, text[s:e]) for k, s, e in find_secrets(text) if (s, e) not in base and k in ("named", "flow")}
    assert len(base) == 1 and {("flow", "Zx9!qwerty"), ("named", "correct horse battery 9")} <= more


def test_inner_scopes_do_not_reach_outer_constants():
    outer = 'K = "Zx9!qwerty"\n'
    assert added(outer + 'def f():\n    K = "other one"\n    return K\n\ndb_pwd = K') == [("flow", "Zx9!qwerty")]
    assert added('const K = "Zx9!qwerty"; function f() { const K = "other one"; } const dbPwd = K;') == [("flow", "Zx9!qwerty")]
    assert added(outer + 'if x:\n    K = "Other1!abc"\ndb_pwd = K') == [("flow", "Other1!abc")]


@pytest.mark.parametrize("size", [5000, 1_000_000])
def test_long_constants_replace_older_ones_and_are_reported_whole(size):
    long = "a1-" * (size // 3)
    text = f'K = "Zx9!qwerty"\nK = "{long}"\ndb_pwd = K'
    assert added(text) == [("flow", long)]
    assert added(f'db_pwd = "{long}"') == [("named", long)]


def test_sums_of_sums_and_odd_texts_stay_linear():
    began = time.perf_counter()
    sums = 'a = "x1y2z3"\n' + "a = a + a\n" * 3000 + "db_pwd = a"
    assert added(sums) == [("flow", "x1y2z3")]
    for text in ('"' * 200_000, "'a " * 100_000, "`" * 99_999, "{" * 100_000 + "a=b", ": " * 100_000, "a=" * 100_000, "x " * 200_000 + "= 1", '\"\"\"a' * 50_000, "<a>" * 60_000):
        find_secrets(text)
    assert time.perf_counter() - began < 20


def _seconds(text):
    best = []
    for _ in range(2):
        began = time.perf_counter()
        find_secrets(text)
        best.append(time.perf_counter() - began)
    return min(best)


#: Texts that grow by one unit: unbroken runs of assignments, query strings, escaped quotes, sums, chains, names of names.
UNITS = [
    "k=v&", "token=", "pwd:", "pwd=a:", "pwd=Zx9!q&", "a=", "\\\"", "\\\"k\\\":\\\"v\\\",", "x=1 + ", "pwd: a1 + ", "pwd += 'x1y2z3'\n", "pwd = pwd + 'x1'\n", "é=ü", "a: b: ", "k='v' ", "<k>v1v2v3", "def f: # :", "{[(",
]


@pytest.mark.parametrize("unit", UNITS)
def test_twice_the_text_takes_about_twice_the_time(unit):
    n = 60_000 // len(unit)
    one, two = _seconds(unit * n), _seconds(unit * 2 * n)
    assert two < 2.5 * one + 0.5


def test_a_megabyte_without_blanks():
    began = time.perf_counter()
    for unit in ("k=v&", "token=", "pwd=Zx9!qwerty:"):
        find_secrets(unit * (1_000_000 // len(unit)))
    assert time.perf_counter() - began < 30


def test_values_in_one_run_are_read_whole():
    text = "url=https://h/?user=me&pwd=Zx9!qwerty&x=1 end"
    assert ("named", "Zx9!qwerty&x=1") in added(text)
    long = "db_pwd=" + "Zx9!qwerty&" * 400 + " K=1"
    assert [x for _, x in added(long)] == ["Zx9!qwerty&" * 400]


def test_counts_of_parts_are_those_of_the_text():
    import random
    from collections import Counter

    from tessella.llm.secrets import Source

    r = random.Random(5)
    text = "".join(r.choice("abcé😀\n=") for _ in range(20_000))
    source = Source(text)
    for _ in range(200):
        a, b = sorted(r.randrange(20_001) for _ in range(2))
        assert source.counts(a, b) == Counter(text[a:b])
