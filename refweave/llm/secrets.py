"""Credentials embedded in source code: find them at their place and redact them without breaking the file.

A keyword automaton and the places where pieces meet mark the lines worth a look; in files that put names together
every line is looked at. On those, issuer formats, assignments to names that stand for
secrets, credentials in URLs, headers and commands, private keys and secrets in pieces are matched by regular
expressions; what is matched must then pass for a usable literal (structure, no placeholder, no reference).
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refweave.session import spread

#: The prefixes issuers begin theirs with, and what follows. Not part of a longer word on either side.
ISSUERS = {
    "aws_key_id": (("AKIA", "ASIA"), r"[A-Z0-9]{16}"),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"[A-Za-z0-9]{36,251}"),
    "github_fine": (("github_pat_",), r"[A-Za-z0-9]{22}_[A-Za-z0-9]{59}"),
    "npm": (("npm_",), r"[A-Za-z0-9]{36}"),
    "sendgrid": (("SG.",), r"[\w-]{16,32}\.[\w-]{16,64}"),
    "slack": (tuple(f"xox{c}-" for c in "abeoprs"), r"[A-Za-z0-9-]{20,}"),
    "stripe": (("sk_live_", "sk_test_", "rk_live_", "rk_test_"), r"[A-Za-z0-9]{16,}"),
    "google": (("AIza",), r"[\w-]{35}"),
    "gitlab": (("glpat-",), r"[\w-]{20,}"),
    "jwt": (("eyJ",), r"[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{16,}"),
    "pypi": (("pypi-",), r"[\w-]{50,}"),
    "hugging": (("hf_",), r"[A-Za-z0-9]{30,}"),
    "digitalocean": (("dop_v1_",), r"[0-9a-f]{64}"),
    "webhook": (("whsec_",), r"[A-Za-z0-9+/=]{24,}"),
}
#: Words that make a name that of a secret, and names whose values count inside an auth object.
SECRET_WORDS = "token secret secrets password passwd passphrase pass pwd pw psw apikey key keys auth authtoken credential credentials creds cred jwt bearer hmac dsn conn bot".split()
AUTH_VALUES = ("value", "data", "content")
#: Keywords of the automaton, lower case: a line without any of them, and without pieces (_PIECES), holds no secret that is
#: looked for. The rules' own words and prefixes, then what URLs, headers and commands need.
KEYWORDS = sorted({*SECRET_WORDS, *AUTH_VALUES, *(p.lower() for prefixes, _ in ISSUERS.values() for p in prefixes), "://", "private", "login", "-u"})
_ISSUER = re.compile(r"(?<![\w+/-])(?:" + "|".join(f"(?P<{n}>(?:{'|'.join(map(re.escape, prefixes))}){rest})" for n, (prefixes, rest) in ISSUERS.items()) + r")(?![\w+/])")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: One line of a key without END: what leads to it (ends of lines, in quotes or escaped), and key material or a header up to its end.
_PEM_LINE = re.compile(
    r"(?:\\+[nrt]|[\"'`]?[ \t]*[+,.\\]?[ \t]*\r?\n[ \t]*(?:[#*>|][ \t]*)?[\"'`]?)+"
    r"(?:(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset): (?:(?!\\+[nrt]|[\"'`])[^\n\r])*|(?P<key>=?[A-Za-z0-9+/]+={0,2}))(?=\\+[nrt]|[\"'`]?[ \t]*[-+,.;)\]}\\]*[ \t]*(?:\r?\n|$))"
)
_BRACE = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|[{}]')
_QUOTED = r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\''
_BARE = r"[^\s\"'#,;&|<>(){}\[\]`\\]+"
_ASSIGN = re.compile(
    rf"(?<![\w$.-])(?P<q>[\"']?)(?P<name>[A-Za-z_][\w.-]*)(?P=q)[ \t]*(?::=|=(?!=)|:(?=[ \t]))[ \t]*(?P<value>{_QUOTED}|{_BARE})?"
)
_JOIN = re.compile(rf"[ \t]*\+[ \t]*({_QUOTED})")
#: Places where pieces meet: names one after the other, quoted strings added up.
_NAMES = re.compile(r"\$\{?[A-Za-z_]\w*\}?\$\{?[A-Za-z_]")
_PIECES = re.compile(rf"{_NAMES.pattern}|[\"'][ \t]*\+[ \t]*[\"']")
_BLOCK = re.compile(r"^(?P<lead>[ \t]*(?:-[ \t]+)?)[\"']?(?P<name>[A-Za-z_][\w.-]*)[\"']?:[ \t]*[>|][+-]?\d?[ \t]*\r?$")
_NEXT = re.compile(r"(?:[ \t]*\r?\n)*[ \t]+(\S+)[ \t]*\r?(?:\n|$)")
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^\s/:@\"'<>]*:)?(?P<value>[^\s/@\"'<>]+)@(?=[\w\[])")
_HEADER = re.compile(
    r"(?i)(?:\bauthorization|\bx-auth(?:-token|-key)?|\bx-api-key|\bapi-key|\bprivate-token|\bx-access-token)[\"']?[ \t]*[:=][ \t]*[\"']?(?:(?:bearer|token|basic|apikey)[ \t]+)?(?P<value>[^\s\"'<>,;`]+)"
)
_FLAG = re.compile(
    r"(?:(?<!\S)-u[ \t]+(?:[\w.-]+:(?P<u>\"[^\"]*\"|'[^']*'|[^\s\"']+)|\"[\w.-]+:(?P<u2>[^\"]*)\"|'[\w.-]+:(?P<u3>[^']*)')"
    r"|\b(?:login|sshpass)\b[^\n]*?[ \t]-p[ \t]*(?P<p>\"[^\"]*\"|'[^']*'|[^\s\"']+)"
    r"|(?<!\S)--(?:password|passwd|token|secret|api-key|auth-token|access-token|passphrase)(?:[ \t]+|=)(?P<f>\"[^\"]*\"|'[^']*'|[^\s\"']+)"
    r"|:_(?:authToken|password|auth)=(?P<n>[^\s\"'`]+)"
    r"|\bmachine[ \t]+\S+[ \t]+login[ \t]+\S+[ \t]+password[ \t]+(?P<m>\S+))"
)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_SECRET_NAME = re.compile(rf"(?:^|_)(?:{'|'.join(SECRET_WORDS)})(?:$|_)")
_PASSWORD_NAME = re.compile(r"(?i)pass|pwd|(?:^|[_-])pw(?:$|[_\d-])")
_OTHER_NAME = re.compile(
    r"(?:^|_)(?:url|uri|name|file|path|env|ref|limit|ttl|type|count|size|host|user|username|header|public|pub|cache|restore|hash|checksum|sha|sha1|sha256|sha512"
    r"|integrity|fingerprint|digest|expiry|expires|version|length|field|prefix|endpoint|store|run|build|commit|pinned|expected|partition|sort|primary|foreign)(?:$|_)|(?:^|_)id_token$"
)
_PLACEHOLDER = re.compile(
    r"(?i)change[-_ ]?me|replace[-_ ]?(?:me|this|with)|\byour|your[-_]|example|placeholder|redacted|dummy|sample|insert[-_ ]|fixme|todo|\btbd\b|not[-_]?a[-_]?|fake|xxxx|\*\*\*|\.\.\.|<[^>]*>|^(?:secret|password|token|none|null|true|false|test|undefined|n/?a)$|(.)\1{7}"
)
_REFERENCE = re.compile(
    r"\$[{(]|^\$|\$[A-Z_][A-Z0-9_]{3,}|\{\{|\}\}|%[A-Za-z_]+%|^(?:env|vault|secret|secrets|ssm|file|op|arn|keyring|ref|var|vars|gcp|aws|azure|kms|sops):|^@|^/(?:run|etc|var|tmp|home|dev)/|^sha(?:1|256|384|512)[-:]|^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$|^\w+\(|^https?://"
)
_VERSION = re.compile(r"^v?\d+(?:\.[\dx]+)+(?:[-+].*)?$|^\d{4}-\d\d-\d\d")


#: An escape of the languages read here, as one piece.
_ESCAPE = re.compile(r"\\(?:(?P<hex>x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})|N\{[^}\n]*\}|(?P<octal>[0-3][0-7]{2})|[0-7]{1,2}|\r\n|[\s\S])")
#: What placeholder() leaves.
_NOTHING = re.compile(r"(?i)[x0\W_]+|[a0\W_]+")


class Found(NamedTuple):
    """start: where the secret begins; spans: what to redact, several for a secret in pieces; rule: what matched."""

    start: int
    spans: tuple[tuple[int, int], ...]
    rule: str


_automaton = None


def automaton():
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for w in KEYWORDS:
            a.add_word(w, len(w))
        a.make_automaton()
        _automaton = a
    return _automaton


def is_secret_name(name: str) -> bool:
    """Whether a name is that of a secret's value, not of something about it."""
    plain = re.sub(r"_?\d+$", "", _CAMEL.sub("_", name).lower().replace("-", "_").replace(".", "_"))
    return bool(_SECRET_NAME.search(plain)) and not _OTHER_NAME.search(plain)


def is_literal(value: str) -> bool:
    """No placeholder, no reference to a value kept elsewhere."""
    return bool(value) and not _PLACEHOLDER.search(value) and not _REFERENCE.search(value) and not _NOTHING.fullmatch(_ESCAPE.sub("", value) if "\\" in value else value)


def is_usable(value: str, least: int = 8, stated: bool = False) -> bool:
    """A literal with the irregularity of a key or password: words, versions, numbers and identifiers are none.

    ``stated``: it stands where only a password can, so one capital inside it is enough.
    """
    if len(value) < least or "=" in value.rstrip("=") or not is_literal(value) or _VERSION.match(value) or " " in value.strip():
        return False
    digits, lower, upper = (any(map(f, value)) for f in (str.isdigit, str.islower, str.isupper))
    if digits:
        return lower or upper
    turns = sum(a.islower() and b.isupper() for a, b in zip(value, value[1:]))
    symbols = sum(not c.isalnum() and c not in "-_./" for c in value)
    return (lower and upper and (turns >= (1 if stated and len(value) >= 10 else 2) or symbols > 0)) or symbols >= 2


def _decoded(value: str) -> str | None:
    try:
        text = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("ascii")
    except (binascii.Error, ValueError):
        return None
    return text if text.isprintable() else None


def _passes(rule: str, value: str) -> bool:
    """Structure of what an issuer's format matched."""
    if not is_literal(value) or len(set(value[4:])) < 6:
        return False
    if rule == "jwt":
        try:
            head = value.split(".")[0]
            return isinstance(json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4))), dict)
        except (ValueError, binascii.Error):
            return False
    return True


def _generic(value: str, least: int = 8, stated: bool = False) -> bool:
    """A usable value under a secret's name. One that decodes to user:password is judged by its password."""
    plain = _decoded(value) if len(value) >= 12 else None
    if plain and ":" in plain and len(plain) > 4:
        return is_literal(plain.split(":", 1)[1])
    return is_usable(value, least, stated)


def _unquote(text: str, at: int, value: str) -> tuple[str, int, int]:
    if value[:1] in "\"'" and len(value) > 1 and value[-1] == value[0]:
        return value[1:-1], at + 1, at + len(value) - 1
    return value, at, at + len(value)


def _unended(content: str, at: int) -> int:
    """Where a key without END stops: before the first line that is no key material. A short line must look like the rest of a key."""
    while m := _PEM_LINE.match(content, at):
        key = m["key"]
        if key and len(key) < 16 and not (key[0] == "=" or key[-1] == "=" or re.search(r"\d|[a-z][A-Z]", key)):
            break
        at = m.end()
    return at


def _closing(content: str, at: int) -> int:
    """Where the object that is open at ``at`` is closed; the end of the file if it is not."""
    depth = 1
    for m in _BRACE.finditer(content, at):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if not depth:
            return m.start()
    return len(content)


def find(content: str | None, path: str = "") -> list[Found]:
    """The secrets of a file in order, each once. ``path`` tells by its extension whether bare words can be values."""
    if not content:
        return []
    low = content.lower()
    if len(low) != len(content) or _NAMES.search(content):
        # lower case changed lengths, or names are put together, whose pieces may stand on any line: look at every line
        starts = [0, *(m.end() for m in re.finditer("\n", content))]
    else:
        hits = sorted({end for end, _ in automaton().iter(low)} | {m.start() for m in _PIECES.finditer(content)})
        if not hits:
            return []
        starts = sorted({content.rfind("\n", 0, h + 1) + 1 if content[h] != "\n" else h + 1 for h in hits})
    quoted_only = path.lower().rsplit(".", 1)[-1] in ("py", "json", "toml")
    found: dict[int, Found] = {}
    covered: list[tuple[int, int]] = []

    def free(s: int, e: int) -> bool:
        """Whether no span kept so far meets (s, e); the kept ones are sorted and apart."""
        i = bisect_left(covered, (s, s))
        return not (i < len(covered) and covered[i][0] < e) and not (i and covered[i - 1][1] > s)

    def add(start: int, spans: list[tuple[int, int]], rule: str) -> None:
        if all(free(s, e) for s, e in spans):
            for span in spans:
                insort(covered, span)
            found[start] = Found(start, tuple(spans), rule)

    literal: dict[str, tuple[str, int, int]] = {}  # what a name was last set to, for secrets in pieces
    for m in _PEM.finditer(content):
        after = _PEM.search(content, m.end())
        end = _PEM_END.search(content, m.end(), after.start() if after else len(content))
        body = content[m.end() : end.start() if end else _unended(content, m.end())]
        plain = re.sub(r"\\[nr]|[^A-Za-z0-9+/=]", "", body)
        if len(plain) >= 64 and len(set(plain)) > 16 and not _REFERENCE.search(body.strip()[:40]) and (not covered or m.start() >= covered[-1][1]):
            add(m.start(), [(m.start(), end.end() if end else m.end() + len(body))], "private_key")
    inside_auth = -1
    for at in starts:
        stop = content.find("\n", at)
        stop = len(content) if stop < 0 else stop
        line = content[at:stop]
        for m in _ISSUER.finditer(line):
            if _passes(m.lastgroup, m[0]):
                add(at + m.start(), [(at + m.start(), at + m.end())], m.lastgroup)
        for m in _URL.finditer(line):
            value = m["value"]
            with_user = ":" in m[0][m[0].index("://") + 3 :]
            if is_usable(value, 6 if with_user else 16, with_user):
                add(at + m.start("value"), [(at + m.start("value"), at + m.end("value"))], "url")
        for m in _HEADER.finditer(line):
            if _generic(m["value"]):
                add(at + m.start("value"), [(at + m.start("value"), at + m.end("value"))], "header")
        for m in _FLAG.finditer(line):
            value, s, e = _unquote(line, m.start(m.lastgroup), m[m.lastgroup])
            if _generic(value, 6, True):
                add(at + s, [(at + s, at + e)], "command")
        if m := _BLOCK.match(line):
            if is_secret_name(m["name"]) and stop < len(content):
                nxt = _NEXT.match(content, stop + 1)
                if nxt and _generic(nxt[1], stated=bool(_PASSWORD_NAME.search(m["name"]))):
                    add(nxt.start(1), [nxt.span(1)], "block")
            continue
        if at >= inside_auth and re.search(r"[\"'](?:auth|credentials?|login)[\"'][ \t]*:[ \t]*\{[ \t]*\r?$", line):
            inside_auth = max(inside_auth, _closing(content, stop))
        comment = line.lstrip()[:1] in ("#", "/", ";")
        for m in _ASSIGN.finditer(line):
            raw = m["value"]
            if not raw:
                continue
            value, s, e = _unquote(line, m.start("value"), raw)
            s, e = at + s, at + e
            is_quoted = raw[0] in "\"'"
            if is_quoted or not quoted_only:
                literal[m["name"]] = (value, s, e)
            named = is_secret_name(m["name"]) or at < inside_auth and m["name"].lower() in AUTH_VALUES
            spans, text, after = [(s, e)], value, m.end()
            while is_quoted and (more := _JOIN.match(line, after)):
                piece, a, b = _unquote(line, more.start(1), more[1])
                spans.append((at + a, at + b))
                text, after = text + piece, more.end()
            names = re.findall(r"\$\{?([A-Za-z_]\w*)\}?", text)
            if len(names) > 1 and not re.sub(r"\$\{?[A-Za-z_]\w*\}?", "", text) and all(n in literal for n in names):
                text, spans = "".join(literal[n][0] for n in names), [literal[n][1:] for n in names]
            issued = _ISSUER.fullmatch(text) if named or len(spans) > 1 else None
            if (is_quoted or comment or not quoted_only) and (named and _generic(text, stated=bool(_PASSWORD_NAME.search(m["name"]))) or issued and _passes(issued.lastgroup, text)):
                add(spans[0][0], spans, "pieces" if len(spans) > 1 else "assignment")
    return [found[k] for k in sorted(found)]


_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_BASE32 = re.compile(r"(?=[A-Z]*[2-7])[A-Z2-7]{16,}=*")
_PADDED = re.compile(r"[A-Za-z0-9+/]{2,}={1,2}")


def placeholder(text: str) -> str:
    """The same length and alphabet, saying nothing.

    Hexadecimal stays hexadecimal (a, A and 0), base32 and padded base64 become A, all else keeps the kind of each
    character (x, X, 0; what is no letter or digit stays).
    """
    if _BASE32.fullmatch(text) or (_PADDED.fullmatch(text) and len(text) % 4 == 0):
        return "A" * len(text.rstrip("=")) + "=" * (len(text) - len(text.rstrip("=")))
    plain = re.sub(r"[\W_]", "", text)
    low = "a" if _HEX.fullmatch(plain) and len(plain) >= 8 else "x"
    return re.sub(r"\d", "0", re.sub(r"[^\W\d_]", lambda m: low.upper() if m[0].isupper() else low, text))


def _blank(secret: str, cut: int) -> str:
    """A span without what it said: escapes stay escapes (their codes become that of A), ``cut`` characters at its start belong to one."""
    out, at = [secret[:cut]], cut
    pieces = [m for m in _ESCAPE.finditer(secret, cut)]
    plain = placeholder("".join(secret[a:b] for a, b in zip([cut, *(m.end() for m in pieces)], [*(m.start() for m in pieces), len(secret)])))
    used = 0
    for m in pieces:
        n = m.start() - at
        out.append(plain[used : used + n])
        used += n
        if m["hex"]:
            out.append("\\" + m["hex"][0] + "41".rjust(len(m["hex"]) - 1, "0"))
        else:
            out.append("\\101" if m["octal"] else m[0])
        at = m.end()
    return "".join([*out, plain[used:]])


_MARKS = re.compile(r"-----(?:BEGIN|END)[^-\n]*-----")


def redact(content: str | None, found: list[Found]) -> str | None:
    """``content`` with every span replaced; the BEGIN and END lines, quotes, escapes and line ends stay."""
    if not content or not found:
        return content
    out, at = [], 0
    for s, e in sorted(span for f in found for span in f.spans):
        out.append(content[at:s])
        secret = content[s:e]
        before = len(content[:s]) - len(content[:s].rstrip("\\")) if content[s - 1 : s] == "\\" else 0
        cut = len(m[0]) - 1 if before % 2 and (m := _ESCAPE.match(content, s - 1)) else 0
        if secret.startswith("-----BEGIN"):
            last = 0
            for m in _MARKS.finditer(secret):
                out += [_blank_lines(secret[last : m.start()]), m[0]]
                last = m.end()
            out.append(_blank_lines(secret[last:]))
        else:
            out.append(_blank(secret, min(cut, len(secret))))
        at = e
    return "".join([*out, content[at:]])


def _blank_lines(body: str) -> str:
    """A key's body: each line's material on its own, what ends lines stays."""
    return re.sub(r"((?:\\(?:[xuU][0-9A-Fa-f]+|[\s\S]))+)|([^\W_]+)", lambda m: _blank(m[1], 0) if m[1] else re.sub(r"\d", "0", re.sub(r"[^\W\d_]", lambda c: "X" if c[0].isupper() else "x", m[2])), body)


_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum_ok(rule: str, value: str) -> bool | None:
    """Whether a token's own checksum is right; None for issuers that publish none.

    The last six characters of these tokens are the CRC-32 of what stands between prefix and them, in base 62.
    """
    if rule not in ("github", "npm") or len(value) != 40:
        return None
    body, n, digits = value[4:-6], zlib.crc32(value[4:-6].encode()), ""
    while n:
        n, r = divmod(n, 62)
        digits = _BASE62[r] + digits
    return bool(body) and digits.rjust(6, "0") == value[-6:]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns kept, then path and content; one row per finding."""
    for batch in batches:
        paths, contents = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1)
        rows, line_no, rules, lengths, sums = [], [], [], [], []
        for i, c in enumerate(contents):
            text = c.as_py()
            done, at = 1, 0
            for f in find(text, paths[i] or ""):
                done += text.count("\n", at, f.start)
                at = f.start
                rows.append(i)
                line_no.append(done)
                rules.append(f.rule)
                lengths.append(sum(b - a for a, b in f.spans))
                value = "".join(text[a:b] for a, b in f.spans)
                issued = _ISSUER.fullmatch(value)
                sums.append(checksum_ok(issued.lastgroup, value) if issued else None)
        if rows:
            kept = pa.Table.from_batches([batch]).select(batch.schema.names[:-2]).take(pa.array(rows)).combine_chunks()
            columns = [c.chunk(0) for c in kept.columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(line_no, pa.int64()), pa.array(rules, pa.string()), pa.array(lengths, pa.int64()), pa.array(sums, pa.bool_())], names=[*kept.column_names, "line_no", "rule", "length", "checksum_ok"])


def find_secrets(files: DataFrame, content: str, path: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, line_no (1-based; lines end at \\n), rule and length of each secret found, row by row.

    checksum_ok grades tokens whose issuer publishes a checksum: true tokens have it, made-up ones mostly not; null elsewhere.

    Null and empty contents, and files without secrets, give no rows; repeated rows repeat their findings;
    a secret in pieces is one finding, on the line of its first piece; contents of any length are read whole.
    A null path only means that its extension says nothing. An empty table gives no rows.
    """
    picked = files.where(F.col(content).isNotNull()).select(*keep, F.col(path).alias("_path"), F.col(content).alias("_content"))
    schema = ", ".join(f"`{c}` {t}" for c, t in picked.dtypes[:-2])
    return spread(picked).mapInArrow(_scan, f"{schema}, line_no long, rule string, length long, checksum_ok boolean")


def redact_files(files: DataFrame, content: str, path: str) -> DataFrame:
    """``files`` with the secrets in ``content`` replaced by placeholders of the same length; all else as it was."""
    kinds = [f"`{c}` {t}" for c, t in files.dtypes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, paths = batch.schema.get_field_index(content), batch.column(path).to_pylist()
            clean = [redact(t, find(t, p or "")) for t, p in zip(batch.column(content).to_pylist(), paths)]
            yield batch.set_column(at, content, pa.array(clean, batch.schema.field(at).type))

    return spread(files).mapInArrow(run, ", ".join(kinds))
