"""Credentials in code, configuration and conversation: find and redact.

Token formats, key armour, connection strings and named values are one
deterministic automaton (:mod:`codestrata.llm.automaton`). It reports where a
value begins (or, for token formats, that one has begun); the value's end and
its usability are then read at that place only. Chunks overlap, and where an
introduction (name, separator, user name) is longer than the overlap the chunk is
scanned again from the right state; places are absolute and each credential is
reported once, however many patterns meet in it. Values may be of any length.

Usable means: six characters or more, neither a placeholder (asterisks, angle or
curly brackets around a name, words such as TODO), nor a lookup (``os.environ``,
``${NAME}``, a call), nor an identifier, nor a UUID. Hashes and ids count only under
a credential's name; of the address of a web hook only the last part is secret.

Defined results: null and empty fields have no credentials; redaction keeps
nulls null and texts without credentials unchanged; spans are counted in code
points from 1; very long texts are scanned whole; repeated rows each give their
rows. Redaction replaces the value alone by a placeholder without quotes or
line breaks (a private key as one block), so quoting and structure stay valid.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from codestrata.llm.automaton import ASCII, WORD, Automaton, alt, chars, lit, many, maybe, seq, some

FIELDS = ("new_code", "old_code", "context")
_low = lambda s: lit(s, case=False)
_SP = chars(" \t")
_Q = chars("\"'`")
_UPPER_DIGIT = chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_BODY = chars(WORD - {"_"})
_NAME = alt(
    _low("password"), _low("passwd"), _low("passphrase"), _low("pwd"), _low("pass"), _low("pw"), _low("secret"), _low("token"), _low("credential"), _low("credentials"), _low("creds"),
    _low("authorization"), _low("header"), seq(_low("auth")),
    seq(alt(_low("api"), _low("secret"), _low("master"), _low("signing"), _low("private"), _low("encryption"), _low("access"), _low("auth"), _low("license"), _low("account"), _low("storage"), _low("service")), maybe(chars("_- .")), _low("key")),
)
_SUFFIX = maybe(alt(lit("_v2"), lit("New"), lit("_")))
_TYPE = alt(seq(many(_SP), lit(":"), many(_SP), maybe(lit("&")), maybe(lit("'static ")), alt(_low("str"), _low("string"))), seq(some(_SP), lit("string")), lit(""))
_SEPARATOR = alt(seq(_TYPE, many(_SP), maybe(lit(":")), lit("=")), seq(many(_SP), lit(":")), seq(many(_SP), lit("=>")), seq(lit(","), many(_SP), lit("value"), many(_SP), lit(":")))
_USER = some(chars(ASCII - set(" \t\r\n\"'`<>:/@")))

PATTERNS = {
    "named": seq(_NAME, _SUFFIX, alt(seq(maybe(_Q), maybe(chars("]")), _SEPARATOR), seq(_Q, lit(","), many(_SP)))),
    "xml": seq(_NAME, lit(">")),
    "url": seq(some(chars("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")), lit("://"), _USER, lit(":")),
    "url_nouser": seq(lit("://"), lit(":")),
    "curl": seq(_SP, alt(lit("-u"), lit("--user")), chars(" =\t"), many(_Q), _USER, lit(":")),
    "creds": seq(alt(_low("creds"), _low("credentials"), _low("login"), _low("account")), chars(" :"), many(_SP), _USER, lit(":")),
    "login": seq(_low("login"), some(_SP), _USER, some(_SP), lit("/"), some(_SP)),
    "login_is": seq(_low("login"), some(_SP), lit("is"), some(_SP), _USER, some(_SP), lit("with"), some(_SP)),
    "key_is": seq(alt(_low("password"), _low("key"), _low("token"), _low("secret"), _low("pw")), some(_SP), lit("is"), some(_SP)),
    "prose": seq(alt(_low("password"), _low("passwd"), _low("passphrase"), _low("pw"), _low("pwd")), some(_SP)),
    "scheme": seq(alt(_low("bearer"), _low("basic"), seq(_Q, _low("token")), seq(lit(":"), _SP, _low("token"))), some(_SP)),
    "armour": seq(lit("-----BEGIN "), many(chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 ")), lit("PRIVATE KEY"), maybe(lit(" BLOCK")), lit("-----")),
    "hook": seq(lit("/services/T"), some(_UPPER_DIGIT), lit("/B"), some(_UPPER_DIGIT), lit("/")),
    "format": alt(
        *[lit(x) for x in ("glpat-", "npm_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "sk_live_", "sk_test_", "rk_live_", "pk_live_", "xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-", "AKIA", "ASIA", "AIza", "eyJ", "sk-", "pypi-", "hf_", "dop_v1_", "shpat_", "SG.")]
    ),
}

# Public token formats, as the services document them.
FORMATS = re.compile(
    r"glpat-[\w-]{20}(?![\w-])|npm_[A-Za-z0-9]{36}(?!\w)|gh[pousr]_[A-Za-z0-9]{36}(?!\w)|github_pat_\w{40,}|[srp]k_(?:live|test)_[A-Za-z0-9]{16,}(?!\w)"
    r"|xox[bpars]-[0-9]+-[\w-]{10,}|A[KS]IA[A-Z0-9]{16}(?!\w)|AIza[\w-]{35}(?![\w-])|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}|sk-[A-Za-z0-9]{20,}(?!\w)"
    r"|pypi-[\w-]{40,}|hf_[A-Za-z0-9]{30,}|dop_v1_[0-9a-f]{64}|shpat_[0-9a-f]{32}|SG\.[\w-]{16,}\.[\w-]{16,}"
)
_QUOTED = re.compile(r"""[ \t]*(?:[bru]?(\"{3}|'{3}|[\"'`])|\\(["']))""")
_BARE = re.compile(r"""[^\s"'`,;&(){}\[\]<>|]+""")
_SCHEME = re.compile(r"(?:bearer|basic|token|digest|apikey|x-[a-z-]*(?:key|token):?|authorization:?)[ \t]+", re.I)
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I)
_PATH = re.compile(r"[A-Za-z_]\w*(?:(?:\.|::|->)[A-Za-z_]\w*)+|[a-z]+(?:_[a-z]+)*(?:_v?\d{1,2}|New|_)?|[A-Z]+(?:_[A-Z0-9]+)*|[A-Za-z][a-z]+(?:[A-Z][a-z]+)*(?:_?v\d{1,2}|_)?")
_DUMMY = re.compile(r"(?i)(?:.*(?:your|example|placeholder|changeme|change_me|replace|redacted|dummy|insert|secret_from|from_vault|vault_|todo|fixme|xxxx|\.\.\.|env\.|environ|getenv|lookup|password|passwd).*|(.)\1*|none|null|true|false|test|foobar)")
#: A name in brackets, a call, an escape: not a value but how one is made.
_TEMPLATE = re.compile(r"<[^<>]*>|\{[^{}]*\}|\$\(|%\(\w|^\(|\w\(\)|\w\([\"'A-Za-z_][^()]*\)$|\\(?:[ntrux0-9\"'\\]|$)")


def usable(v: str, quoted: bool) -> bool:
    if len(v) < 6 or any(c.isspace() for c in v) or _TEMPLATE.search(v) or not quoted and re.search(r"[<>{}()\\]", v):
        return False
    if v[0] in "$%@" and re.match(r"[$%@][A-Za-z_{(]\w*\)?}?$", v) or _UUID.fullmatch(v) or _DUMMY.fullmatch(v) or _PATH.fullmatch(v):
        return False
    digit, lower, upper = any(c.isdigit() for c in v), any(c.islower() for c in v), any(c.isupper() for c in v)
    special = any(not c.isalnum() and c not in "_.-/:" for c in v)
    if not digit and not (special and len(v) >= 8):
        return False
    if not (lower or upper) or v.startswith(("sha256-", "sha384-", "sha512-", "http://", "https://", "/", "./")):
        return False
    if "://" in v:
        return False
    if re.fullmatch(r"[0-9a-f]{24,}|[0-9A-F]{24,}", v):
        return True
    if re.fullmatch(r"[A-Za-z0-9]{3,}[!$#%*^~?][A-Za-z0-9]{3,}", v):
        return True
    kinds = digit + lower + upper + special
    return kinds >= 3 or (digit and (special or "-" in v or len(v) >= 16)) if quoted else kinds >= 3 and len(v) >= 8 and not re.fullmatch(r"\w+[.]\w+", v) or len(v) >= 20 and digit and "." not in v


def _quoted_or_bare(text: str, at: int) -> tuple[int, int, bool] | None:
    m = _QUOTED.match(text, at)
    if m:
        close = m.group(1) or "\\" + m.group(2)
        line = text.find("\n", m.end())
        end = text.find(close, m.end(), line if line >= 0 else len(text))
        return (m.end(), end, True) if end >= 0 else None
    m = re.compile(r"[ \t]*").match(text, at)
    b = _BARE.match(text, m.end())
    return (b.start(), b.end(), False) if b else None


def _value(text: str, at: int, name: str) -> tuple[int, int, str] | None:
    """(start, end, kind) of the credential whose introduction ends at ``at``."""
    if name == "armour":
        start = text.rfind("-----BEGIN", 0, at)
        m = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----").search(text, at)
        nxt = text.find("-----BEGIN", at)
        end = m.end() if m and (nxt < 0 or m.start() < nxt) else at
        inner = re.sub(r"[^A-Za-z0-9+/=]", "", text[at : m.start()].replace("\\n", "")) if end > at else ""
        return (start, end, "private_key") if len(inner) >= 16 or end == at and re.match(r"(?:\\n|\s)*[A-Za-z0-9+/=]{16}", text[at:]) else None
    if name == "format":
        for back in (11, 8, 7, 6, 5, 4, 3):  # the lengths of the formats' beginnings
            start = at - back
            if start >= 0 and (m := FORMATS.match(text, start)) and m.end() > at and (start == 0 or not (text[start - 1].isalnum() or text[start - 1] == "_")):
                body = m.group()
                return None if _DUMMY.fullmatch(body) or len(set(body[8:])) < 5 else (start, m.end(), "token")
        return None
    if name in ("url", "url_nouser"):
        m = re.compile(r"[^\s\"'`<>@/]+(?=@[\w.-])").match(text, at)
        return (m.start(), m.end(), "password") if m and usable(m.group(), True) else None
    if name == "hook":
        m = re.compile(r"[A-Za-z0-9]{16,}(?!\w)").match(text, at)
        return (m.start(), m.end(), "token") if m else None
    if name in ("curl", "creds", "login", "login_is", "key_is", "prose"):
        m = re.compile(r"[^\s\"'`,;<>(){}]+").match(text, at)
        if not m:
            return None
        strict = name in ("prose", "key_is")
        v = m.group().rstrip(".:?") if strict else m.group()
        return (m.start(), m.start() + len(v), "password") if usable(v, not strict or len(v) >= 8 and not v.islower()) and not v.startswith(("http", "=")) else None
    if name == "scheme":
        m = re.compile(r"[^\s\"'`,;<>(){}\\]+").match(text, at)
        if not m:
            return None
        v = m.group()
        if text[:at].rstrip()[-5:].lower() == "basic":
            return (m.start(), m.end(), "login") if _login(v) else None
        return (m.start(), m.end(), "token") if usable(v, True) else None
    got = _quoted_or_bare(text, at)
    if not got:
        return None
    start, end, quoted = got
    s = _SCHEME.match(text, start, end)
    if s or text[start:end].lower() in ("basic", "bearer", "token", "x-api-key:"):
        if not quoted and not s:
            s = _SCHEME.match(text, start)
        if not s:
            return None
        basic = s.group().lower().startswith("basic")
        start = s.end()
        if not quoted:
            b = _BARE.match(text, start)
            if not b:
                return None
            end = b.end()
        if basic:
            return (start, end, "login") if _login(text[start:end]) else None
        quoted = True
    v = text[start:end]
    if quoted:
        return (start, end, "secret") if usable(v, True) else None
    # a named value without quotes is code unless nothing but the value follows
    if end < len(text) and text[end] in "([" or "." in v and re.match(r"[A-Za-z_]\w*\.[A-Za-z_]", v):
        return None
    return (start, end, "secret") if usable(v, False) else None


def _login(v: str) -> bool:
    try:
        plain = base64.b64decode(v, validate=True).decode("utf-8")
    except (binascii.Error, ValueError):
        return False
    return ":" in plain and plain.isprintable()


_AUTOMATON: list[Automaton] = []


def automaton() -> Automaton:
    """Built once by the driver; tasks get its table (about 2 MB) by broadcast."""
    if not _AUTOMATON:
        _AUTOMATON.append(Automaton(PATTERNS))
    return _AUTOMATON[0]


def find(texts: list[str | None], auto: Automaton | None = None) -> list[list[tuple[int, int, str]]]:
    """For each text its credentials as (start, end, kind), from 0, apart and in order."""
    auto = auto or automaton()
    found: list[dict[int, tuple[int, int, str]]] = [{} for _ in texts]
    filled = [t or "" for t in texts]
    for which, at, bits in auto.scan(filled):
        text = filled[which]
        for i, name in enumerate(auto.names):
            if bits >> i & 1 and (v := _value(text, at, name)):
                old = found[which].get(v[0])
                # in an address the grammar of addresses tells where the value ends
                if old is None or name == "url" or (old[1] < v[1] and "@" not in text[old[1] : old[1] + 1]):
                    found[which][v[0]] = v
    out = []
    for spans in found:
        kept: list[tuple[int, int, str]] = []
        for v in sorted(spans.values(), key=lambda s: (s[0], -s[1])):
            if kept and v[0] < kept[-1][1]:
                continue
            kept.append(v)
        out.append(kept)
    return out


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    if not text or not spans:
        return text
    parts, at = [], 0
    for start, end, kind in spans:
        parts += [text[at:start], f"REDACTED_{kind.upper()}"]
        at = end
    return "".join([*parts, text[at:]])


def _slices(pdf: pd.DataFrame, chars_at_once: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Pieces of a batch whose texts together stay small, so that memory does not follow the batch."""
    size = sum(pdf[f].str.len().fillna(0) for f in FIELDS).cumsum() // chars_at_once
    for _, part in pdf.groupby(size, sort=False):
        yield part


def locate(df: DataFrame, key: str = "id") -> DataFrame:
    """(id, field, start_at, end_at, kind) of every credential; narrow, no shuffle."""

    shared = df.sparkSession.sparkContext.broadcast(automaton())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pdf in _slices(batch):
                rows = []
                for field in FIELDS:
                    for k, spans in zip(pdf[key], find(list(pdf[field]), shared.value), strict=True):
                        rows += [(k, field, s + 1, e, kind) for s, e, kind in spans]
                yield pd.DataFrame(rows, columns=["id", "field", "start_at", "end_at", "kind"])

    return df.select(key, *FIELDS).mapInPandas(run, "id string, field string, start_at bigint, end_at bigint, kind string")


def redacted(df: DataFrame, key: str = "id") -> DataFrame:
    """(id, new_code, old_code, context, n_redacted) with placeholders for credentials."""

    shared = df.sparkSession.sparkContext.broadcast(automaton())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pdf in _slices(batch):
                out = {"id": pdf[key].to_numpy()}
                count = [0] * len(pdf)
                for field in FIELDS:
                    spans = find(list(pdf[field]), shared.value)
                    out[field] = [redact(t, s) for t, s in zip(pdf[field], spans, strict=True)]
                    count = [c + len(s) for c, s in zip(count, spans, strict=True)]
                yield pd.DataFrame(out | {"n_redacted": count})

    return df.select(key, *FIELDS).mapInPandas(run, "id string, new_code string, old_code string, context string, n_redacted int")
