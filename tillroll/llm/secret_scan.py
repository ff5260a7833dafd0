"""Secrets in texts: sure matches, and parts of credentials linked with each other.

Sure kinds are reported wherever they stand: ``assign`` (a named value of 8 or more
characters), ``access`` (an access identifier) and ``hex`` (32 or more hex digits).
Weak candidates are a login name (``login``), a random-looking run of characters
(``token``) and the address of a service (``endpoint``). On their own they say nothing; one is
reported only if a complementary part lies in its scope, at most ``REACH`` code points away:
a token next to an identifier, a login or an endpoint with a name before a password, a login next to
a secret, an endpoint next to a secret and, unless it holds a name and a password itself, an identifier.

Parts of one class don't overlap and are in order, so the interval join of two classes is a
binary search for each part.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.words import pieces

REACH = 200
KINDS = ("assign", "access", "hex", "login", "token", "endpoint")
MASK = "[SECRET]"

# The sure patterns.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")

_LOGIN = re.compile(
    r"""(?<![A-Za-z0-9_])(?:user(?:_?name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}""",
    re.IGNORECASE | re.ASCII,
)
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_ENDPOINT = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s"'<>]+""", re.ASCII)
_USERINFO = re.compile(r"[^:/]+://[^:/@]+:[^/@]+@")

Span = tuple[str, int, int]


def _random_looking(run: str) -> bool:
    """Upper and lower case, digits, and at least 3.5 bits in a character."""
    if not (re.search("[A-Z]", run) and re.search("[a-z]", run) and re.search("[0-9]", run)):
        return False
    n = len(run)
    return -sum(c / n * math.log2(c / n) for c in Counter(run).values()) >= 3.5


def _near(part: Span, others: list[Span], reach: int) -> bool:
    """Whether one of ``others`` (in order, apart from each other) lies within reach."""
    at = bisect_left(others, part[1] - reach, key=lambda x: x[2])
    while at < len(others) and others[at][1] <= part[2] + reach:
        if others[at] != part:
            return True
        at += 1
    return False


def _sure(text: str) -> list[Span]:
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def _apart(parts: list[Span]) -> list[Span]:
    """In order, leaving out what overlaps an earlier part."""
    out: list[Span] = []
    for part in sorted(parts, key=lambda x: (x[1], x[2])):
        if not out or part[1] >= out[-1][2]:
            out.append(part)
    return out


def text_spans(text: str, reach: int = REACH) -> list[Span]:
    """Kind, start and end (code points, end exclusive) of every secret, by start, then kind."""
    sure = _sure(text)
    named = ":" in text or "=" in text
    taken = _apart(sure)

    def free(parts: list[Span]) -> list[Span]:
        return [p for p in parts if not _near((p[0], p[1] + 1, p[2] - 1), taken, 0)]

    logins = free([("login", *m.span()) for m in _LOGIN.finditer(text)]) if named else []
    ends = [("endpoint", *m.span()) for m in _ENDPOINT.finditer(text)] if "://" in text else []
    known = [p for p in ends if _USERINFO.match(text, p[1], p[2])]  # these name who logs in
    names = _apart([p for p in sure if p[0] == "access"] + logins + known)
    found = list(sure)
    # A token counts only next to an identifier or an endpoint, so without them none is looked for.
    tokens: list[Span] = []
    if names or ends:
        tokens = free([("token", *m.span()) for m in _TOKEN.finditer(text) if _random_looking(m[0])])
        inside = _apart(ends)
        tokens = [t for t in tokens if not _near((t[0], t[1] + 1, t[2] - 1), inside, 0)]
    secrets = _apart([p for p in sure if p[0] != "access"] + tokens)
    found += [t for t in tokens if _near(t, names, reach)]
    found += [p for p in logins if _near(p, secrets, reach)]
    found += [p for p in ends if (p in known or _near(p, names, reach)) and _near(p, secrets, reach)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """Per row of ``docs``: id and ``spans``, an array of (kind, start, end) in code points.

    Null and empty texts have no spans. Null ids and repeated rows are kept as they are;
    no other column is read.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches):
        for part in pieces(batches):
            found = [
                [{"kind": k, "start": s, "end": e} for k, s, e in text_spans(t, reach)] if t else []
                for t in part.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found, kind)], names=["id", "spans"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, spans array<struct<kind: string, start: long, end: long>>"
    return texts.mapInArrow(scan, schema).withColumnRenamed("id", id_col)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span, and what overlaps it, replaced by one mask."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with secrets masked in the text; the length column, if there, follows a changed text."""
    at = docs.columns.index(text_col)
    size = docs.columns.index(length_col) if length_col in docs.columns else None

    def scan(batches):
        for batch in batches:
            named = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            for part in pieces([named], f"c{at}"):
                texts = part.column(at).to_pylist()
                new = [masked(t, text_spans(t)) if t else t for t in texts]
                columns = list(part.columns)
                columns[at] = pa.array(new, part.column(at).type)
                if size is not None:
                    lengths = [
                        len(b) if a != b else n
                        for a, b, n in zip(texts, new, part.column(size).to_pylist(), strict=True)
                    ]
                    columns[size] = pa.array(lengths, part.column(size).type)
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(scan, plain.schema).toDF(*docs.columns)
