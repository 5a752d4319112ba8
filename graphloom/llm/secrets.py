"""Secret scans: assignments, access keys, hex strings, and strings with a poor token efficiency.

Besides three fixed patterns, any run of 20 or more key characters that a public byte-level vocabulary
needs many tokens for (under `MAX_CHARS_PER_TOKEN` characters a token) is taken for random, unless it overlaps
a span found by a pattern or is a known digest (hex of a digest's length, or one that names its algorithm) or
identifier: a UUID, a number, or a run whose parts between separators are all words, words with a short
number, or numbers of a date's length, as in slugs, paths, dates and names.

Defined results: a null or empty text has no spans; repeated rows and rows without a doc_id are scanned each;
a very long text is scanned whole; offsets are in code points, ends exclusive; an empty table gives an empty
result; other columns are never looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textkit as tk

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = re.compile(rb"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HINTS = [b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"]
MIN_VALUE, MIN_ACCESS, MIN_HEX, MIN_RANDOM = 6, 20, 24, 20
MAX_CHARS_PER_TOKEN = 2.0
#: Lengths of hex digests: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
#: A digest that names its algorithm, as in package locks.
NAMED_DIGEST = re.compile(rb"(?i:md5|sha-?(1|224|256|384|512))[-_=/:][0-9A-Za-z+/=_-]+")
#: Parts of identifiers: words in one case, capitalised or run together, with up to four digits; numbers of up to
#: eight digits, with the T and Z of dates.
PART = re.compile(rb"([A-Z]?[a-z]{2,})+[0-9]{0,4}|[A-Z]{2,}[0-9]{0,4}|[A-Za-z]?[0-9]{1,4}|[0-9]{1,8}(T[0-9]{1,6})?Z?|[A-Za-z]")
SEPARATORS = re.compile(rb"[-_/+=]+")
#: A part of an identifier is no longer than this, and at least this share of the letters of its words are vowels.
MAX_PART, MIN_VOWELS = 24, 0.2
VOWELS = frozenset(b"aeiouyAEIOUY")
UUID = re.compile(rb"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
HEX = tk.byte_class(b"0123456789abcdef")
KEY = tk.byte_class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
SPANS_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

_encodings: dict[str, object] = {}


def encoding(ranks_path: str, pattern: str):
    """The tiktoken encoding of a ranks file, made once per process."""
    if ranks_path not in _encodings:
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[ranks_path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[ranks_path]


def efficiency(run: bytes, enc) -> float:
    """Characters per token; long runs are tokenised in pieces, as time grows faster than length."""
    pieces = [run[i : i + 256].decode() for i in range(0, len(run), 256)]
    return len(run) / sum(len(enc.encode_ordinary(p)) for p in pieces)


def excluded(run: bytes) -> bool:
    """Known digests and identifiers."""
    core = run.strip(b"=-_/+")
    parts = SEPARATORS.split(core)
    if not core or b"".join(parts).isdigit() or UUID.search(core) or NAMED_DIGEST.fullmatch(core):
        return True
    if len(parts) > 1 and all(len(p) <= MAX_PART and PART.fullmatch(p) for p in parts):
        letters = b"".join(re.findall(rb"[A-Za-z]{3,}", core))
        if sum(c in VOWELS for c in letters) >= MIN_VOWELS * len(letters):
            return True
    return len(core) in DIGEST_LENGTHS and re.fullmatch(rb"[0-9a-f]+|[0-9A-F]+", core) is not None


def scan_block(b: tk.Block, enc) -> list[list[tuple[int, int, int]]]:
    """Per text, its spans as (start, end, kind) in bytes of the text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(b.n)]
    for kind, table, least in ((2, HEX, MIN_HEX), (3, KEY, MIN_RANDOM)):
        starts, ends, _ = b.spans(table[b.raw])
        long = np.flatnonzero(ends - starts >= least)
        rows = np.searchsorted(b.at, starts[long], "right") - 1
        # Empty texts share an offset with the next text; the last of them holds the run.
        for s, e, i in zip(starts[long].tolist(), ends[long].tolist(), rows.tolist(), strict=True):
            out[i].append((s - int(b.at[i]), e - int(b.at[i]), kind))
    flat = b.raw.tobytes()
    for row in _rows_with(b, flat, [b"AKIA"]):
        out[row] += [(m.start(), m.end(), 1) for m in ACCESS.finditer(b.text(row)) if m.end() - m.start() >= MIN_ACCESS]
    for row in _rows_with(b, tk.LOWER[b.raw].tobytes(), HINTS):
        out[row] += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(b.text(row)) if len(m[2]) >= MIN_VALUE]
    for row in range(b.n):
        if out[row]:
            out[row] = _judged(b, row, out[row], enc)
    return out


def _judged(b: tk.Block, row: int, spans: list[tuple[int, int, int]], enc) -> list[tuple[int, int, int]]:
    base = [x for x in spans if x[2] < 3]
    for s, e, _ in (x for x in spans if x[2] == 3):
        run = b.raw[int(b.at[row]) + s : int(b.at[row]) + e].tobytes()
        if any(s < y[1] and y[0] < e for y in base if y[2] < 3) or excluded(run):
            continue
        if efficiency(run, enc) < MAX_CHARS_PER_TOKEN:
            base.append((s, e, 3))
    return sorted(base, key=lambda x: (x[0], x[2]))


def _rows_with(b: tk.Block, flat: bytes, needles: list[bytes]) -> list[int]:
    """Texts that hold one of the needles."""
    rows = set()
    for needle in needles:
        at = flat.find(needle)
        while at >= 0:
            row = int(np.searchsorted(b.at, at, "right")) - 1
            if at + len(needle) <= b.at[row + 1]:
                rows.add(row)
                at = flat.find(needle, int(b.at[row + 1]))
            else:
                at = flat.find(needle, at + 1)
    return sorted(rows)


def _listed(b: tk.Block, row: int, spans: list[tuple[int, int, int]]) -> list[str]:
    """kind:start:end in code points."""
    if not spans:
        return []
    lead = np.concatenate(([0], np.cumsum(tk.LEAD[b.raw[b.at[row] : b.at[row + 1]]])))
    return [f"{KINDS[k]}:{lead[s]}:{lead[e]}" for s, e, k in spans]


def _scanner(ranks_path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            rows = []
            for b in tk.blocks(tk.string_column(batch, "text")):
                for i, spans in enumerate(scan_block(b, enc)):
                    listed = _listed(b, i, spans)
                    kinds = [k for _, _, k in spans]
                    base = ",".join(x for x, k in zip(listed, kinds, strict=True) if k < 3)
                    rows.append((*(kinds.count(k) for k in range(3)), hashlib.sha256(base.encode()).hexdigest(), ",".join(listed)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def scan(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row per document row: counts per base kind, base_sha256, and all spans.

    `ranks_path` is a tiktoken ranks file that every executor has, `pattern` its splitting pattern."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scanner(ranks_path, pattern), SPANS_SCHEMA)
