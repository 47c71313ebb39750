"""Secret scans: fixed forms, and dictionary-primed zstandard novelty.

Three fixed forms (assignments, access keys, long hexadecimal runs) give the base spans. The method adds
others, of kind ``novel``. Its candidates are all runs of 12 or more letters, digits and the signs of
encoded text that start within ``CONTEXT`` characters after a sensitive word; the context carries on over
candidates that follow each other with only a line end, blanks or signs between, as the lines of a private
key do, and over up to ``MISSES`` of them that are not reported. A zstandard compressor is primed with a dictionary of identifiers, paths and common code; a candidate's
novelty is the number of bytes it adds to its compressed surroundings, over its length. Words, paths and
repeated identifiers compress, secrets don't: a candidate of at least ``threshold`` is reported. Text of one
kind of letters for long (words run together, names, numbers) must add ``PLAIN`` bytes a character or more. A
candidate that a base span covers in part is judged, and reported, whole.

Whole texts are scanned in one map without a shuffle. Defined results: null and empty texts have no span;
of spans with one start the kinds come in the order listed; repeated rows give repeated rows; an empty
table gives an empty one; null ids stay null; texts of any length are scanned whole, in time that follows their
length; a column with the name of the result is replaced, and other columns are not touched.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from marquee.llm.common import appended

KINDS = ("assign", "access", "hex", "novel")
CONTEXT, PLAIN, CHAINED, MISSES = 48, 1.05, 0.85, 3

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs: those of fewer than 24 are dropped either way
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_=.-]{10,}[A-Za-z0-9+/_=-]")
_SENSITIVE = re.compile(r"(?<![a-z])(?:key|pass(?:word|wd|phrase)?|pwd|secret|token|auth(?!or)|credential|bearer|private|signature|session)|(?:api|access|secret|private)_?key", re.I | re.A)
_BETWEEN = re.compile(r"[\s.,:;\"'\\|*>#-]{0,12}")
_CHANGES = re.compile("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+")

#: What code and configuration commonly hold beside a value; raw content of the compressor's dictionary.
DICTIONARY = (
    "def return import from class self None True False public static void private const function var let export default "
    "https://www.example.com/index.html http://localhost:8080/api/v1/users?id= application/json Content-Type charset=utf-8 "
    "username user_id password_reset access_token refresh_token client_secret authorization_header session_identifier "
    "database_connection_string configuration environment production development localhost private_key public_key "
    "0123456789 1234567890 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ the and of to in is that for with "
    "die der und das nicht eine les des que pour dans los las una por con aeiou tion ment keit ung ción "
    "international configuration authentication authorization administration documentation implementation representation "
    "responsibility communication information environment application organization transformation understanding "
    "getElementById addEventListener setTimeout toString prototype constructor initialize serialize controller repository "
    "service factory manager handler listener provider adapter builder parser formatter validator converter container component template "
    "src/main/java/com/example/ src/main/resources/ node_modules/ usr/local/lib/ var/log/ etc/ docs/reference/ tests/unit/ assets/images/ index.html package.json settings.yaml "
    "getUserById createUser updateSession deleteToken findByName isEnabled hasPermission max_connections min_length default_value first_name last_name created_at request_timeout "
    "2024-01-01T00:00:00 2025-12-31T23:59 2026-06-15T12:30 1.0.0 2.1.3-beta 0.9.12-alpha 3.4.5-release-snapshot "
).encode()


class Novelty:
    """Marginal compressed bytes of a candidate against its surroundings."""

    def __init__(self) -> None:
        import zstandard

        primed = zstandard.ZstdCompressionDict(DICTIONARY, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compress = zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False, write_checksum=False).compress

    def __call__(self, text: str, start: int, end: int) -> float:
        around = (text[max(0, start - 400) : start] + text[end : end + 200]).encode("utf-8", "surrogatepass")
        candidate = text[start:end].encode("utf-8", "surrogatepass")
        return (len(self.compress(around + b" " + candidate)) - len(self.compress(around + b" "))) / len(candidate)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def bar(candidate: str, threshold: float, chained: bool = False, covered: bool = False) -> float:
    """The novelty that a candidate must reach: encoded text changes between kinds of characters often, and the
    symbols of longer ones are coded by their frequency. After one of its kind, or one that base spans cover in part,
    its symbols are known already; a key of few symbols then costs little more than these take by themselves."""
    n, known = len(candidate), CHAINED if chained or covered else 1.0
    if len(_CHANGES.findall(candidate)) < 0.35 * n:
        return PLAIN * known
    asked = threshold * (1.0 if n <= 24 else 0.92 if n <= 64 else 0.82) * known
    return min(asked, 0.85 * math.log2(len(set(candidate))) / 8) if chained else asked


def uncovered(text: str, start: int, end: int, spans: list[tuple[int, int, str]]) -> str:
    """text between start and end without what spans, in the order of their starts, cover."""
    out, at = [], start
    for a, b, _ in spans:
        if a > at:
            out.append(text[at : min(a, end)])
        at = max(at, b)
    return "".join([*out, text[at:end]])


def novel_spans(text: str, base: list[tuple[int, int, str]], novelty: Novelty, threshold: float) -> list[tuple[int, int, str]]:
    # reach: how far the context of sensitive words goes; near: the end of the last one found, or of MISSES not found after it
    out, reach, near, missed = [], -1, 0, 0
    words = _SENSITIVE.finditer(text)
    word = next(words, None)
    if word is None:
        return []
    # open: base spans that may reach into what comes; at: the first one ahead. Both only move on, so spans are seen once.
    at, open_ = 0, []
    for m in _CANDIDATE.finditer(text, max(0, word.start() - 64)):
        start, end = m.span()
        while word is not None and word.end() <= start:
            reach, word = word.end() + CONTEXT, next(words, None)
        while at < len(base) and base[at][0] < end:
            open_.append(base[at])
            at += 1
        open_ = [span for span in open_ if span[1] > start]
        chained = near and _BETWEEN.fullmatch(text, near, start) is not None
        if start > reach and not chained:
            near = 0
            continue
        held = [span for span in open_ if span[0] < end]
        # What a base span covers tells nothing of the rest.
        rest = uncovered(text, start, end, held) if held else m[0]
        if not rest:
            near, missed = end, 0
            continue
        if novelty(text, start, end) >= bar(rest, threshold, bool(chained), bool(held)):
            out.append((start, end, "novel"))
            near, missed = end, 0
        else:
            missed += 1
            near = end if chained and missed <= MISSES else 0
    return out


def scan(text: str | None, novelty: Novelty | None, threshold: float = 0.85) -> tuple[list, list]:
    """(base spans, all spans) of a text, each (start, end, kind) in order; base spans alone without a novelty."""
    text = text or ""
    base = base_spans(text)
    if novelty is None:
        return base, base
    return base, sorted(base + novel_spans(text, base, novelty, threshold), key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str, spans: list, mark: str = "[SECRET]") -> str:
    """text with the union of its spans replaced."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


FIELDS = [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("redacted", pa.string())]


def find_secrets(df: DataFrame, text_col: str = "text", threshold: float = 0.85, name: str = "found", keep: list[str] | None = None, redact: bool = True, novel: bool = True) -> DataFrame:
    """The columns of df (or those in keep) with a struct: n_assign, n_access, n_hex, base_sha256, spans, and the redacted text.

    Without ``novel`` the fixed forms alone are looked for."""
    fields = FIELDS if redact else FIELDS[:-1]

    def make() -> callable:
        novelty = Novelty() if novel else None

        def found(texts: list[str | None]) -> list[pa.Array]:
            rows = []
            for text in texts:
                base, spans = scan(text, novelty, threshold)
                kinds = [k for *_, k in base]
                row = (*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))
                rows.append((*row, text if text is None or not spans else redacted(text, spans)) if redact else row)
            return [pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)], [n for n, _ in fields])]

        return found

    ddl = ", ".join(f"{n}: {'long' if kind == pa.int64() else 'string'}" for n, kind in fields)
    return appended(df, text_col, make, f"{name} struct<{ddl}>", keep, most_bytes=4 << 20)


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = find_secrets(df, text_col, keep=[id_col], redact=False)
    return found.select(id_col, *(f"found.{c}" for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")))
