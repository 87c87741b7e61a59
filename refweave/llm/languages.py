"""Token streams and grammars of the languages whose files are checked: JSON, TOML 1.0, YAML 1.1 and Python 3.

A lexical error becomes the token ERROR, which no grammar knows.
"""

from __future__ import annotations

import io
import keyword
import re
import tokenize
from collections.abc import Iterator

from refweave.llm.derivatives import Grammar

ERROR = "ERROR"

# ---------------------------------------------------------------- JSON
JSON = {
    "value": "STRING | NUMBER | CONSTANT | '{' [ member ( ',' member )* ] '}' | '[' [ value ( ',' value )* ] ']'",
    "member": "STRING ':' value",
}
_JSON = re.compile(
    r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false|null)|($)|(.))',
    re.S | re.A,
)


def json_tokens(text: str) -> Iterator[str]:
    for m in _JSON.finditer(text):
        kind = m.lastindex
        if kind == 5:
            return
        yield m[1] if kind == 1 else (None, None, "STRING", "NUMBER", "CONSTANT", None, ERROR)[kind]


# ---------------------------------------------------------------- TOML
TOML = {
    "document": "line*",
    "line": "[ pair | '[' key ']' | '[[' key ']]' ] NL",
    "pair": "key '=' value",
    "key": "( BARE | STRING ) ( '.' ( BARE | STRING ) )*",
    "value": "VALUE | STRING | TEXT | '{' [ pair ( ',' pair )* ] '}' | '[' NL* [ value NL* ( ',' NL* value NL* )* [ ',' NL* ] ] ']'",
}
_ESC = r'\\(?:[btnfr"\\]|u(?!d[89a-f])[0-9a-f]{4}|U00(?:0[0-9a-f]|10)[0-9a-f]{4})'
_TOML_SPACE = re.compile(r"[ \t]*(?:#[^\x00-\x08\x0a-\x1f\x7f]*)?")
_TOML_STRING = re.compile(
    rf"(\"\"\"(?:[^\"\\\x00-\x08\x0b-\x1f\x7f]|\r\n|(?i:{_ESC})|\\[ \t]*\r?\n|\"{{1,2}}(?!\"))*\"{{3,5}}|'''(?:[^'\x00-\x08\x0b-\x1f\x7f]|\r\n|'{{1,2}}(?!'))*'{{3,5}})"
    rf"|(\"(?:[^\"\\\x00-\x08\x0a-\x1f\x7f]|(?i:{_ESC}))*\"|'[^'\x00-\x08\x0a-\x1f\x7f]*')"
)
_TOML_BARE = re.compile(r"[A-Za-z0-9_-]+")
_TIME = r"(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?"
_TOML_VALUE = re.compile(
    rf"(?:\d{{4}}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?:[Tt ]{_TIME}(?:[Zz]|[+-](?:[01]\d|2[0-3]):[0-5]\d)?)?|{_TIME}"
    r"|true|false|[+-]?(?:inf|nan)|0x[0-9A-Fa-f](?:_?[0-9A-Fa-f])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*"
    r"|[+-]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?)(?=[\s,\]}#]|$)",
    re.A,
)


def toml_tokens(text: str) -> Iterator[str]:
    at, n, stack, is_value = 0, len(text), [], False  # stack of open brackets; is_value: a value is expected, not a key
    line_start = True
    while True:
        at = _TOML_SPACE.match(text, at).end()
        if at >= n:
            yield "NL"
            return
        c = text[at]
        if c == "\n" or text.startswith("\r\n", at):
            at += 1 if c == "\n" else 2
            yield "NL"
            if not stack:
                line_start, is_value = True, False
            continue
        if line_start and c == "[":
            head = "[[" if text.startswith("[[", at) else "["
            yield head
            at += len(head)
            stack.append("head" if head == "[" else "heads")
        elif c == "]" and stack and stack[-1] in ("head", "heads"):
            tail = "]]" if stack.pop() == "heads" and text.startswith("]]", at) else "]"
            yield tail
            at += len(tail)
        elif c in "[{" and is_value:
            yield c
            at += 1
            stack.append(c)
            is_value = c == "["
        elif c in "]}":
            yield c
            at += 1
            if stack:
                stack.pop()
            is_value = bool(stack) and stack[-1] == "["
        elif c == ",":
            yield c
            at += 1
            is_value = bool(stack) and stack[-1] == "["
        elif c == "=":
            yield c
            at += 1
            is_value = True
        elif c == "." and not is_value:
            yield c
            at += 1
        elif m := _TOML_STRING.match(text, at):
            yield "TEXT" if m[1] else "STRING"
            at = m.end()
        elif m := (_TOML_VALUE if is_value else _TOML_BARE).match(text, at):
            yield "VALUE" if is_value else "BARE"
            at = m.end()
        else:
            yield ERROR
            return
        line_start = False


# ---------------------------------------------------------------- YAML
YAML = {
    "stream": "SS [ implicit ] ( directive* DS [ node ] DE* )* SE",
    "implicit": "node DE*",
    "directive": "DIRECTIVE",
    "node": "ALIAS | props [ content ] | content",
    "either": "ALIAS | props [ content | indentless ] | content | indentless",
    "props": "TAG [ ANCHOR ] | ANCHOR [ TAG ]",
    "content": "SCALAR | flow | BSEQ ( BENTRY [ node ] )* BEND | BMAP ( KEY [ either ] [ VALUE [ either ] ] )* BEND",
    "indentless": "( BENTRY [ node ] )+",
    "flow": "FSEQ [ item ( FENTRY item )* [ FENTRY ] ] FSEQEND | FMAP [ item ( FENTRY item )* [ FENTRY ] ] FMAPEND",
    "item": "flownode | KEY [ flownode ] [ VALUE [ flownode ] ]",
    "flownode": "ALIAS | props [ SCALAR | flow ] | SCALAR | flow",
}
#: The scanner's token names.
_YAML_KINDS = {
    "StreamStartToken": "SS", "StreamEndToken": "SE", "DocumentStartToken": "DS", "DocumentEndToken": "DE", "DirectiveToken": "DIRECTIVE",
    "AliasToken": "ALIAS", "AnchorToken": "ANCHOR", "TagToken": "TAG", "ScalarToken": "SCALAR", "BlockSequenceStartToken": "BSEQ",
    "BlockMappingStartToken": "BMAP", "BlockEndToken": "BEND", "BlockEntryToken": "BENTRY", "KeyToken": "KEY", "ValueToken": "VALUE",
    "FlowSequenceStartToken": "FSEQ", "FlowSequenceEndToken": "FSEQEND", "FlowMappingStartToken": "FMAP", "FlowMappingEndToken": "FMAPEND",
    "FlowEntryToken": "FENTRY",
}


def yaml_tokens(text: str) -> Iterator[str]:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("checking YAML files needs PyYAML's scanner") from e
    handles, fresh = {"!", "!!"}, True
    try:
        for token in yaml.scan(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
            kind = _YAML_KINDS[type(token).__name__]
            if kind == "DIRECTIVE":
                if fresh:
                    handles, fresh = {"!", "!!"}, False
                if token.name == "TAG":
                    handles.add(token.value[0])
                elif token.name == "YAML" and token.value[0] != 1:
                    kind = ERROR
            elif kind == "TAG" and token.value[0] is not None and token.value[0] not in handles:
                kind = ERROR
            elif kind == "DE":
                fresh = True
            yield kind
    except (yaml.YAMLError, UnicodeError, ValueError):
        yield ERROR


# ---------------------------------------------------------------- Python
PYTHON = {
    "file": "( NEWLINE | stmt )* ENDMARKER",
    "stmt": "simple | compound",
    "simple": "small ( ';' small )* [ ';' ] NEWLINE",
    "small": "assignment | exprs | 'pass' | 'break' | 'continue' | 'return' [ exprs ] | 'raise' [ expr [ 'from' expr ] ] | 'del' deltargets"
    " | 'global' name ( ',' name )* | 'nonlocal' name ( ',' name )* | 'assert' expr [ ',' expr ] | import | 'type' name [ typeparams ] '=' expr",
    "import": "'import' dotted [ 'as' name ] ( ',' dotted [ 'as' name ] )* | 'from' source 'import' ( '*' | '(' names [ ',' ] ')' | names )",
    "source": "( '.' | '...' )* dotted | ( '.' | '...' )+",
    "names": "name [ 'as' name ] ( ',' name [ 'as' name ] )*",
    "dotted": "name ( '.' name )*",
    "name": "NAME | 'match' | 'case' | 'type' | '_'",
    # assignments; targets and expressions are derived side by side
    "assignment": "( targets '=' )+ ( exprs | yield ) | single AUGMENTED ( exprs | yield ) | annotated ':' expr [ '=' ( exprs | yield ) ]",
    "annotated": "name | '(' single ')' | place",
    "single": "name | place | '(' single ')'",
    "place": "atom trailer* ( '.' name | '[' slices ']' )",
    "targets": "startarget ( ',' startarget )* [ ',' ]",
    "startarget": "[ '*' ] target",
    "target": "name | place | '(' [ targets ] ')' | '[' [ targets ] ']'",
    "deltargets": "deltarget ( ',' deltarget )* [ ',' ]",
    "deltarget": "name | place | '(' [ deltargets ] ')' | '[' [ deltargets ] ']'",
    # expressions
    "exprs": "starexpr ( ',' starexpr )* [ ',' ] | yield",
    "starexpr": "'*' bits | expr",
    "yield": "'yield' [ 'from' expr | starexpr ( ',' starexpr )* [ ',' ] ]",
    "expr": "disjunction [ 'if' disjunction 'else' expr ] | 'lambda' [ lambdaparams ] ':' expr",
    "named": "name ':=' expr | expr",
    "disjunction": "inversion ( ( 'and' | 'or' ) inversion )*",
    "inversion": "'not' * comparison",
    "comparison": "bits ( ( COMPARE | 'in' | 'not' 'in' | 'is' | 'is' 'not' ) bits )*",
    "bits": "unary ( ( '+' | '-' | '*' | BINARY ) unary )*",
    "unary": "( '+' | '-' | '~' )* [ 'await' ] atom trailer* [ '**' unary ]",
    "trailer": "'.' name | '(' [ arguments ] ')' | '[' slices ']'",
    "atom": "name | NUMBER | string+ | 'None' | 'True' | 'False' | '...' | '(' [ yield | group ] ')' | '[' [ group ] ']' | '{' [ dict | set ] '}'",
    "group": "item ( ',' item )* [ ',' ] | item forin+",
    "item": "'*' bits | named",
    "set": "item ( ',' item )* [ ',' ] | named forin+",
    "dict": "entry ( ',' entry )* [ ',' ] | expr ':' expr forin+",
    "entry": "expr ':' expr | '**' bits",
    "forin": "[ 'async' ] 'for' targets 'in' disjunction ( 'if' condition )*",
    "condition": "disjunction | name ':=' expr",
    "slices": "slice ( ',' slice )* [ ',' ]",
    "slice": "named | '*' bits | [ expr ] ':' [ expr ] [ ':' [ expr ] ]",
    "string": "STRING | FSTART fpart* FEND",
    "fpart": "FMIDDLE | '{' ( exprs ) [ '=' ] [ '!' name ] [ ':' fpart* ] '}'",
    # arguments: positional, then keywords, then double stars
    "arguments": "named forin+ [ ',' ] | positional | keywords",
    "positional": "( named | '*' expr ) [ ',' [ positional | keywords ] ]",
    "keywords": "( name '=' expr | '*' expr ) [ ',' [ keywords ] ] | doubled",
    "doubled": "'**' expr [ ',' [ rest ] ]",
    "rest": "name '=' expr [ ',' [ rest ] ] | doubled",
    # compound statements
    "block": "NEWLINE INDENT stmt+ DEDENT | simple",
    "compound": "if | while | for | try | with | def | class | decorated | 'async' ( def | with | for ) | matching",
    "if": "'if' named ':' block ( 'elif' named ':' block )* [ 'else' ':' block ]",
    "while": "'while' named ':' block [ 'else' ':' block ]",
    "for": "'for' targets 'in' exprs ':' block [ 'else' ':' block ]",
    "try": "'try' ':' block ( finally | ( 'except' [ expr [ 'as' name ] ] ':' block )+ [ 'else' ':' block ] [ finally ]"
    " | ( 'except' '*' expr [ 'as' name ] ':' block )+ [ 'else' ':' block ] [ finally ] )",
    "finally": "'finally' ':' block",
    "with": "'with' ( withitem ( ',' withitem )* | '(' withitem ( ',' withitem )* [ ',' ] ')' ) ':' block",
    "withitem": "expr [ 'as' target ]",
    "def": "'def' name [ typeparams ] '(' [ params ] ')' [ '->' expr ] ':' block",
    "class": "'class' name [ typeparams ] [ '(' [ arguments ] ')' ] ':' block",
    "decorated": "( '@' named NEWLINE )+ ( def | class | 'async' def )",
    "typeparams": "'[' typeparam ( ',' typeparam )* [ ',' ] ']'",
    "typeparam": "name [ ':' expr ] [ '=' expr ] | '*' name [ '=' starexpr ] | '**' name [ '=' expr ]",
    # parameters: plain ones before defaults, one slash, one star, named ones after it
    "params": "plain [ ',' [ params | slash ] ] | default [ ',' [ defaults | dslash ] ] | stars",
    "slash": "'/' [ ',' [ after ] ]",
    "after": "plain [ ',' [ after ] ] | default [ ',' [ dafter ] ] | stars",
    "defaults": "default [ ',' [ defaults | dslash ] ] | stars",
    "dslash": "'/' [ ',' [ dafter ] ]",
    "dafter": "default [ ',' [ dafter ] ] | stars",
    "stars": "'*' name [ ':' starexpr ] [ ',' [ named_only ] ] | '*' ',' must | '**' plain [ ',' ]",
    "must": "( plain | default ) [ ',' [ named_only ] ]",
    "named_only": "( plain | default ) [ ',' [ named_only ] ] | '**' plain [ ',' ]",
    "plain": "name [ ':' expr ]",
    "default": "plain '=' expr",
    "lambdaparams": "name [ ',' [ lambdaparams | lslash ] ] | ldefault [ ',' [ ldefaults | ldslash ] ] | lstars",
    "lslash": "'/' [ ',' [ lafter ] ]",
    "lafter": "name [ ',' [ lafter ] ] | ldefault [ ',' [ ldafter ] ] | lstars",
    "ldefaults": "ldefault [ ',' [ ldefaults | ldslash ] ] | lstars",
    "ldslash": "'/' [ ',' [ ldafter ] ]",
    "ldafter": "ldefault [ ',' [ ldafter ] ] | lstars",
    "lstars": "'*' name [ ',' [ lnamed ] ] | '*' ',' lmust | '**' name [ ',' ]",
    "lmust": "( name | ldefault ) [ ',' [ lnamed ] ]",
    "lnamed": "( name | ldefault ) [ ',' [ lnamed ] ] | '**' name [ ',' ]",
    "ldefault": "name '=' expr",
    # pattern matching
    "matching": "'match' subject ':' NEWLINE INDENT ( 'case' patterns [ 'if' named ] ':' block )+ DEDENT",
    "subject": "named | starexpr ',' [ starexpr ( ',' starexpr )* [ ',' ] ]",
    "patterns": "pattern | ( pattern | '*' name ) ',' [ sequence ]",
    "sequence": "( pattern | '*' name ) ( ',' ( pattern | '*' name ) )* [ ',' ]",
    "pattern": "closed ( '|' closed )* [ 'as' name ]",
    "closed": "[ '-' ] NUMBER [ ( '+' | '-' ) NUMBER ] | string+ | 'None' | 'True' | 'False' | dotted [ '(' [ classargs ] ')' ] | '(' [ sequence ] ')' | '[' [ sequence ] ']' | '{' [ mapping ] '}'",
    "mapping": "( '**' name | mapkey ':' pattern ) ( ',' ( '**' name | mapkey ':' pattern ) )* [ ',' ]",
    "mapkey": "[ '-' ] NUMBER [ ( '+' | '-' ) NUMBER ] | string+ | 'None' | 'True' | 'False' | name ( '.' name )+",
    "classargs": "pattern [ ',' [ classargs ] ] | classkeys",
    "classkeys": "name '=' pattern ( ',' name '=' pattern )* [ ',' ]",
}
_PY_OPERATORS = (
    dict.fromkeys("== != < > <= >=".split(), "COMPARE")
    | dict.fromkeys("/ // % @ << >> & ^ |".split(), "BINARY")
    | dict.fromkeys("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split(), "AUGMENTED")
)
_PY_WORDS = {*keyword.kwlist, "match", "case", "type", "_"}
_PY_SKIP = {tokenize.COMMENT, tokenize.NL, tokenize.ENCODING, tokenize.TYPE_COMMENT}
_PY_KINDS = {
    tokenize.NUMBER: "NUMBER", tokenize.STRING: "STRING", tokenize.NEWLINE: "NEWLINE", tokenize.INDENT: "INDENT", tokenize.DEDENT: "DEDENT",
    tokenize.ENDMARKER: "ENDMARKER", tokenize.FSTRING_START: "FSTART", tokenize.FSTRING_MIDDLE: "FMIDDLE", tokenize.FSTRING_END: "FEND",
}


def python_tokens(text: str) -> Iterator[str]:
    if "\0" in text:
        yield ERROR
        return
    text = text.removeprefix("﻿")
    depth = 0
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            kind, value = t.type, t.string
            if kind in _PY_SKIP:
                continue
            if kind == tokenize.NAME:
                yield value if value in _PY_WORDS else "NAME"
            elif kind == tokenize.OP:
                depth += (value in "([{") - (value in ")]}")
                known = _PY_OPERATORS.get(value, value)
                # '@', '|' and '/' have rules of their own too
                yield value if value in ("@", "|", "/") else known
            else:
                yield _PY_KINDS.get(kind, ERROR)
    except (tokenize.TokenError, SyntaxError, ValueError):
        yield ERROR


PYTHON["bits"] = "unary ( ( '+' | '-' | '*' | '@' | '|' | '/' | BINARY ) unary )*"

_LANGUAGES = {
    "json": (JSON, "value", json_tokens), "toml": (TOML, "document", toml_tokens), "yaml": (YAML, "stream", yaml_tokens), "python": (PYTHON, "file", python_tokens),
}
#: The language of a file by its extension.
EXTENSIONS = {"yml": "yaml", "yaml": "yaml", "json": "json", "py": "python", "toml": "toml"}
_grammars: dict[str, Grammar] = {}


def failure(language: str, text: str) -> int:
    """-1 if ``text`` is one valid text of ``language``, else the position of the failing token (their number: it ends too early)."""
    rules, start, tokens = _LANGUAGES[language]
    if language not in _grammars:
        _grammars[language] = Grammar(rules, start)
    return _grammars[language].run(list(tokens(text)))
