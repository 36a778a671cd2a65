"""Operator 2, secret scans by token efficiency.

Three rules find secrets by form: assignments to secret-like names, access key ids and long
hexadecimal runs. The method adds what has no form of its own: a run of key characters that
a byte-pair vocabulary of natural text spells in few characters a token is random, as words
and names merge into long tokens and random strings don't. Before that, known digests
(hexadecimal of a digest's length, integrity strings), UUIDs, numbers and names made of
plain words are excluded, and so is whatever overlaps a rule's span: rules come first. A name
is plain only if the vocabulary spells its words in few tokens. Where a whole run is not
random, its parts between separators are tested in the same way; where it is, plain words
before the first and after the last random part, set off by slashes or equal signs, are no
part of the span.

The vocabulary is read on the driver from a path that is a parameter and broadcast (it is
a fixed file of about a megabyte). Documents are scanned where they lie, whole, without a
shuffle.

Defined cases. Null text is empty and has no spans. Repeated rows are scanned each. Offsets
are code points, ends exclusive. An empty table gives an empty result. Extra columns are
dropped by scan_secrets()."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drumlin.llm.common import in_slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's published splitting pattern.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # as [0-9a-f]+ with the short ones dropped, since runs are maximal
NAMES = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "random")
# Lengths of hexadecimal digests (MD5, SHA-1, SHA-2), and other known forms.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
INTEGRITY = re.compile(r"sha(1|224|256|384|512)[-=]")
HEXADECIMAL = re.compile(r"[0-9a-fA-F]+")
PLAIN_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
SHORTEST = 20
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
SEGMENT = re.compile(r"[^/=]+")
PART = re.compile(r"[A-Za-z0-9]{20,}")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(n in low for n in NAMES):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def known_form(run: str) -> bool:
    """Digests and identifiers, which are no secrets however random they look."""
    if UUID.fullmatch(run) or INTEGRITY.match(run):
        return True
    return bool(HEXADECIMAL.fullmatch(run)) and len(run) in DIGEST_LENGTHS


def plain_name(run: str, count_tokens, most_ratio: float) -> bool:
    """Names and paths of words (capital first, all capitals) that are tokens or are spelt in few, and plain numbers."""
    if mixed(run):
        return False
    words = PLAIN_WORD.findall(run)
    tokens = [count_tokens(w) for w in words]
    return all(n == 1 for n in tokens) or sum(map(len, words)) >= most_ratio * sum(tokens)


def is_random(run: str, count_tokens, most_ratio: float) -> bool:
    return not known_form(run) and len(run) / count_tokens(run) <= most_ratio and not plain_name(run, count_tokens, most_ratio)


def mixed(run: str) -> bool:
    """Whether letters and digits, or both cases, alternate as they don't in names."""
    kinds = re.sub(r"[^A-Za-z0-9]", "", run)
    changes = sum(a.isdigit() != b.isdigit() or (a.islower() and b.isupper()) for a, b in zip(kinds, kinds[1:]))
    return changes * 6 >= len(kinds)


def without_plain_ends(run: str, count_tokens, most_ratio: float) -> tuple[int, int]:
    """Where the random part of a random run begins and ends."""
    plain = lambda p: not p or (not mixed(p) and plain_name(p, count_tokens, most_ratio))
    parts = [(m.start(), m.end()) for m in SEGMENT.finditer(run)]
    while len(parts) > 1 and plain(run[slice(*parts[0])]):
        parts.pop(0)
    while len(parts) > 1 and plain(run[slice(*parts[-1])]):
        parts.pop()
    start, end = parts[0][0], parts[-1][1]
    end += len(run[end:]) - len(run[end:].lstrip("="))  # padding belongs to what it pads
    return (start, end) if end - start >= SHORTEST else (0, len(run))


def random_spans(text: str, taken: list[tuple[int, str, int]], count_tokens, most_ratio: float) -> list[tuple[int, str, int]]:
    if max(map(len, text.split()), default=0) < SHORTEST:
        return []
    out = []
    for m in RUN.finditer(text):
        start, end = m.span()
        if any(s < end and start < e for s, _, e in taken) or known_form(m[0]):
            continue
        if is_random(m[0], count_tokens, most_ratio):
            first, last = without_plain_ends(m[0], count_tokens, most_ratio)
            out.append((start + first, "random", start + last))
        else:
            out += [(start + p.start(), "random", start + p.end()) for p in PART.finditer(m[0]) if is_random(p[0], count_tokens, most_ratio)]
    return out


def load_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_counters: dict[str, object] = {}


def token_counter(raw: bytes):
    """Counts tokens under the vocabulary; one encoder for each worker process."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _counters:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        encoding = tiktoken.Encoding("scan", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        _counters[key] = lambda s: len(encoding.encode_ordinary(s))
    return _counters[key]


def scan_text(text: str | None, count_tokens, most_ratio: float) -> tuple[int, int, int, int, str, str]:
    text = text or ""
    base = base_spans(text)
    spans = sorted([*base, *random_spans(text, base, count_tokens, most_ratio)], key=lambda s: (s[0], KINDS.index(s[1])))
    shown = [",".join(f"{k}:{s}:{e}" for s, k, e in x) for x in (base, spans)]
    counts = [sum(k == kind for _, k, _ in spans) for kind in KINDS]
    return (*counts, hashlib.sha256(shown[0].encode()).hexdigest(), shown[1])


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, most_ratio: float = 2.4) -> DataFrame:
    """One row for each document: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    `most_ratio` is the largest number of characters a token at which a run is random."""
    spark = docs.sparkSession
    raw = spark.sparkContext.broadcast(load_vocabulary(vocabulary))
    source = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text}`").cast("string").alias("__text"))
    names = [id_col, "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(raw.value)
        for batch in in_slices(batches):
            rows = [scan_text(t, count, most_ratio) for t in batch.column(1).to_pylist()]
            columns = [pa.array([r[i] for r in rows], pa.int64() if i < 4 else pa.string()) for i in range(6)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return source.mapInArrow(run, f"`{id_col}` {dict(source.dtypes)[id_col]}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def redact(docs: DataFrame, *, text: str = "text", mark: str = "[secret]", vocabulary: str = VOCABULARY, most_ratio: float = 2.4) -> DataFrame:
    """`docs` with every span in `text` replaced by `mark`; overlapping spans become one."""
    spark = docs.sparkSession
    raw = spark.sparkContext.broadcast(load_vocabulary(vocabulary))
    at = docs.columns.index(text)

    def clean(value: str | None, count) -> str | None:
        if not value:
            return value
        base = base_spans(value)
        out, pos = [], 0
        for start, _, end in sorted([*base, *random_spans(value, base, count, most_ratio)]):
            if start >= pos:
                out += [value[pos:start], mark]
            pos = max(pos, end)
        return "".join([*out, value[pos:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(raw.value)
        for batch in in_slices(batches):
            yield batch.set_column(at, batch.schema.field(at), pa.array([clean(t, count) for t in batch.column(at).to_pylist()], pa.string()))

    return docs.mapInArrow(run, docs.schema)
