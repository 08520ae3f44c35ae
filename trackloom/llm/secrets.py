"""Secret scans: fixed patterns, and strings that zstandard finds new in a sensitive context.

The patterns give the base spans.  Beyond them, a string on either side of a sensitive word is
a candidate; zstandard is primed with a dictionary of common identifiers, a short
passage of prose and code that settles its letter statistics, and the text around the
string, and the bytes that the string adds to these are measured.  A string that hardly compresses is reported as `novel`.
Each document is judged by itself in one pass, without a shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

#: Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")

_SENSITIVE = re.compile(r"password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|authorization|bearer|signature", re.IGNORECASE | re.ASCII)
SHORTEST = 16
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
#: Characters between a sensitive word and a candidate on either side of it, and of text around it that primes the compressor.
REACH, CONTEXT = 64, 400
#: Bytes that a reported string adds at least, as a share of its own length.
NOVELTY = 0.76
#: Identifiers of configuration and code that never are secrets.
IDENTIFIERS = (
    "password passwd passphrase secret token api_key apikey access_key secret_key private_key public_key client_id client_secret "
    "credential credentials authorization Authorization Bearer Basic signature username user_name email account session cookie "
    "config configuration settings environment variable default example placeholder changeme your_token_here your_api_key_here "
    "https http localhost example.com import from return function class const static public private string String self None null true false "
    "getenv process.env os.environ encrypt decrypt hash digest sha256 base64 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 "
    "xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx 00000000000000000000000000000000 -------------------------------- ________________________________ ================================"
)
#: Goes before every context, so that also a bare one is compressed by the letter statistics of common text.
PASSAGE = (
    "The quick brown fox jumps over the lazy dog while five wizards box with jugs of liquor. Settings are read when a process starts, "
    "and values given on the command line go before those of the file. "
    "int main(void) { for (size_t i = 0; i < count; ++i) { total += values[i] * 2; } return total > 10 ? 1 : 0; } "
    "def load(path): with open(path) as f: return [line.strip().split(',') for line in f if line] # 1 to 9, 2024-06-17 08:53 "
)

SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, "
    "spans array<struct<kind:string,start:int,end:int>>"
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), sorted."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18] if "AKIA" in text else []
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class Novelty:
    """The marginal compressed bytes of a string against its surroundings."""

    def __init__(self, identifiers: str = IDENTIFIERS):
        words = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=9, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)

    def share(self, text: str, start: int, end: int) -> float:
        around = (PASSAGE + text[max(0, start - CONTEXT) : start] + text[end : end + CONTEXT]).encode()
        own = text[start:end].encode()
        added = len(self.compressor.compress(around + b"\n" + own)) - len(self.compressor.compress(around + b"\n"))
        return added / len(own)


def candidates(text: str) -> list[tuple[int, int]]:
    """Strings in reach of a sensitive word: whole ones, and what such words leave of those that they are in.

    One pass over the strings; each sensitive word is met by the string that it lies in.
    """
    near = [m.span() for m in _SENSITIVE.finditer(text)]
    if not near:
        return []
    found, ends = set(), [end for _, end in near]
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        word = bisect_left(ends, start - REACH)
        if word == len(near) or near[word][0] > end + REACH:
            continue
        found.add((start, end))
        edges, word = [start], bisect_right(ends, start)
        while word < len(near) and near[word][0] < end:
            edges += near[word]
            word += 1
        if len(edges) > 1:
            pieces = [*zip(edges[::2], [*edges[1::2], end], strict=True), (edges[2], end)]
            found.update((a, b) for a, b in pieces if b - a >= SHORTEST)
    return sorted(found, key=lambda x: (x[0], -x[1]))


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """Candidates that add most of their bytes; none that a base span or a longer candidate reports whole."""
    found: list[tuple[int, int, int]] = []
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    for start, end in candidates(text):
        before = bisect_right(starts, start)  # base spans that start no later; the farthest of them may hold the candidate
        # those found start no later, and each ends beyond the one before it
        if found and end <= found[-1][2] or before and end <= reach[before - 1]:
            continue
        if novelty.share(text, start, end) >= NOVELTY:
            found.append((start, 3, end))
    return found


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    novelty = Novelty()
    for batch in batches:
        rows: dict[str, list] = {"n_assign": [], "n_access": [], "n_hex": [], "n_novel": [], "spans": []}
        for value in batch.column("text"):
            text = value.as_py() or ""
            base = base_spans(text)
            spans = sorted(base + novel_spans(text, base, novelty))
            for k, name in enumerate(KINDS):
                rows[f"n_{name}"].append(sum(x[1] == k for x in spans))
            rows["spans"].append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        counts = [pa.array(rows[f"n_{k}"], pa.int64()) for k in KINDS]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(rows["spans"], kind)], ["doc_id", *(f"n_{k}" for k in KINDS), "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document row: counts by kind and all spans in code points, end exclusive, by start, then kind.

    Null and empty texts have no spans; repeated rows are each scanned; other
    columns are not read.
    """
    return docs.select("doc_id", "text").mapInArrow(_find, SCHEMA)
