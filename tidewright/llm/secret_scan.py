"""Secret scans: fixed patterns, and strings that a tokenizer's vocabulary encodes badly.

Ordinary words cost few tokens for their length; random strings cost about one token for every one or two
characters. Strings with few characters per token count as secrets, unless they are digests of a known length or
identifiers of a known form.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit as K

#: The patterns, in the order of their kinds. The second is the least length, of the group named.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
#: Lengths of hexadecimal digests, and forms of identifiers that are no secrets.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
_IDENTIFIER = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9+/_=-]+|0[xX][0-9a-fA-F]+")
_HEXADECIMAL = re.compile(r"[0-9a-f]+|[0-9A-F]+")
LEAST_LENGTH = 16
_CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST_LENGTH},}}")
#: Parts between joints: the sign of assignment, and those that keys of base64 and base64url may hold themselves.
_PARTS = tuple(map(re.compile, (r"[^=]+", r"[^=/+]+", r"[^=/+_-]+")))
#: For letters of one case, of which whole words have longer tokens in lower case.
LOWER_RATIO, UPPER_RATIO = 1.85, 1.75

_SCHEMA = "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) in code points, in order."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def token_counter(vocabulary: str) -> Callable[[str], int]:
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coding = tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda s: len(coding.encode_ordinary(s))


def is_excluded(s: str) -> bool:
    """Digests of a known length, UUIDs, numbers and addresses."""
    return bool(_IDENTIFIER.fullmatch(s)) or len(s) in DIGEST_LENGTHS and bool(_HEXADECIMAL.fullmatch(s))


def random_spans(text: str, taken: list[tuple[int, int, int]], count: Callable[[str], int], least_ratio: float, letters_ratio: float) -> list[tuple[int, int, int]]:
    """Strings of LEAST_LENGTH characters or more, outside the spans taken, with few characters for each token.

    One with letters and digits needs a ratio below least_ratio. One of letters alone may be a long compound, so it
    must mix cases after its first letter and stay below letters_ratio; one of a single case and without joints has
    the limits LOWER_RATIO and UPPER_RATIO. A string that passes as a whole is split at its joints, one
    kind after another, since words beside a random part raise the ratio: first the run of neighbouring parts that
    costs most is tested, as a key may hold joints of its own, and then each part.
    """
    out = []

    def limit_of(s: str) -> float:
        if len(s) < LEAST_LENGTH or is_excluded(s):
            return 0
        letters, digits = any(c.isalpha() for c in s), any(c.isdigit() for c in s)
        if letters and digits:
            return least_ratio
        if s[1:] != s[1:].lower() and s != s.upper():
            return letters_ratio
        return 0 if not s.isalpha() else UPPER_RATIO if s == s.upper() else LOWER_RATIO

    def is_random(s: str) -> bool:
        limit = limit_of(s)
        return limit > 0 and len(s) < limit * count(s)

    def costliest(s: str, parts: list[tuple[int, int]]) -> tuple[int, int]:
        """Of runs of neighbouring parts, the one whose tokens exceed those allowed by most; a joint is a token."""
        best, sum_, begin, found = 0.0, 0.0, 0, (0, 0)
        for a, b in parts:
            if sum_ <= 0:
                sum_, begin = 0.0, a
            sum_ += least_ratio * (count(s[a:b]) + 1) - (b - a + 1)
            if sum_ > best:
                best, found = sum_, (begin, b)
        return found

    def test(first: int, last: int) -> None:
        todo = [(first, last, 0, True)]
        while todo:
            start, end, level, whole = todo.pop()
            s = text[start:end]
            if len(s) < LEAST_LENGTH or is_excluded(s):
                continue
            if whole and is_random(s):
                out.append((start, 3, end))
                continue
            while level < len(_PARTS) and _PARTS[level].fullmatch(s):
                level += 1
            if level == len(_PARTS):
                continue
            parts = [m.span() for m in _PARTS[level].finditer(s)]
            a, b = costliest(s, parts) if level else (0, 0)
            if is_random(s[a:b]):
                out.append((start + a, 3, start + b))
                todo += [(start, start + a, level, False), (start + b, end, level, False)]
            else:
                todo += [(start + a, start + b, level + 1, True) for a, b in parts]

    k = 0
    for m in _CANDIDATE.finditer(text):
        start = m.start()
        while k < len(taken) and taken[k][2] <= start:
            k += 1
        j = k
        while j < len(taken) and taken[j][0] < m.end():
            test(start, taken[j][0])
            start = max(start, taken[j][2])
            j += 1
        test(start, m.end())
    return out


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(docs: DataFrame, make: Callable, id_col: str, text_col: str, schema: str, vocabulary: str | None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = K.held(("vocabulary", vocabulary), lambda: token_counter(vocabulary))
        for batch in batches:
            yield make(batch, count)

    return docs.mapInArrow(work, schema)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_ratio: float = 1.75, letters_ratio: float = 1.5, vocabulary: str | None = None) -> DataFrame:
    """One row per input row with counts by kind and all spans, `kind:start:end` joined by commas, in code points.

    A map over rows without a shuffle; the vocabulary file is at the same path on every executor. Null text counts as
    empty: no spans. Null ids, repeated ids and repeated rows pass through row by row; an empty table gives no rows;
    other columns are not read. Texts are scanned whole.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def make(batch: pa.RecordBatch, count: Callable[[str], int]) -> pa.RecordBatch:
        rows = []
        for text in batch.column(text_col).to_pylist():
            base = base_spans(text or "")
            extra = random_spans(text or "", base, count, least_ratio, letters_ratio)
            ranks = [k for _, k, _ in base]
            rows.append((ranks.count(0), ranks.count(1), ranks.count(2), len(extra), hashlib.sha256(_join(base).encode()).hexdigest(), _join(sorted(base + extra))))
        names = [x.split() for x in _SCHEMA.split(", ")]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([batch.column(id_col), *(pa.array(c, pa.int64() if t == "long" else pa.string()) for c, (_, t) in zip(columns, names, strict=True))], [id_col, *(n for n, _ in names)])

    return _scan(docs.select(id_col, text_col), make, id_col, text_col, f"`{id_col}` {kind}, {_SCHEMA}", vocabulary)


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", least_ratio: float = 1.75, letters_ratio: float = 1.5, vocabulary: str | None = None) -> DataFrame:
    """The same rows and columns; in the text, each stretch of overlapping spans becomes `mark`. Null text stays null."""

    def clean(text: str | None, count: Callable[[str], int]) -> str | None:
        if not text:
            return text
        base = base_spans(text)
        out, at = [], 0
        for a, _, b in sorted(base + random_spans(text, base, count, least_ratio, letters_ratio)):
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def make(batch: pa.RecordBatch, count: Callable[[str], int]) -> pa.RecordBatch:
        k = batch.schema.get_field_index(text_col)
        return batch.set_column(k, text_col, pa.array([clean(t, count) for t in batch.column(text_col).to_pylist()], batch.schema.field(k).type))

    return _scan(docs, make, "", text_col, docs.schema, vocabulary)
