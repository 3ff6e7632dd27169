"""Quality rules by compression bands.

Repetitive text compresses too well and random text not at all. Each document is
compressed with zstandard as a whole and in chunks of about 1 KiB; the limits of the ratio
(compressed bytes / bytes) depend on the length, since a short text has had no
chance to repeat itself. The lower limit is a share of the entropy of the text's
bytes, so that a small alphabet, which compresses well without any repetition, does
not count as repetition.

``reason`` names the first rule that a document breaks: ``words`` and ``repeats`` of the
base, then ``repetitive`` or ``random`` of the band of the whole text, then ``chunks``.

Edge cases: a null text counts as empty; an empty text has no words and fails the
base rule; white space alone likewise. A null id is passed through. Repeated rows
are judged one by one, so equal rows get equal verdicts. A very long text is
compressed as a whole and its words are counted in one task, which takes some tens of
times its size. Other columns of the input play no part, whatever their names. An
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import encode, per_row, table

#: Fixed values: (bytes below which the band holds, lowest ratio as a share of the byte entropy, highest
#: ratio) of a document or a chunk of that length. The lowest lies up to 5 % below the least of the good
#: labelled documents of sf0.1 (and their pieces), since the bad ones lie below them; the highest about 0.05
#: above the greatest, between good text and random characters. From 64 KiB there are no labels: the
#: lowest goes on falling as before.
BANDS = (
    (512, 1.06, 0.77),
    (700, 1.015, 0.73),
    (900, 0.965, 0.68),
    (1100, 0.925, 0.66),
    (1536, 0.91, 0.63),
    (2048, 0.86, 0.63),
    (4096, 0.832, 0.57),
    (8192, 0.788, 0.525),
    (16384, 0.765, 0.50),
    (65536, 0.735, 0.48),
    (float("inf"), 0.70, 0.48),
)
#: A document of two chunks or more is cut into equal ones of about so many bytes, and fails if over one
#: sixteenth of its bytes lie in chunks outside their band; below 16 chunks that is any chunk. No good
#: labelled document of sf0.1 has one.
CHUNK = 1024
OUTSIDE = 1 / 16
LEVEL = 3
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50


def entropy(raw: bytes) -> float:
    """The share of its size that ``raw`` needs if each byte is coded by its frequency alone."""
    n = np.bincount(np.frombuffer(raw, np.uint8))
    share = n[n > 0] / len(raw)
    return float(-(share * np.log2(share)).sum() / 8)


def outside(raw: bytes, packer: zstandard.ZstdCompressor) -> str | None:
    """``repetitive`` if below what its bytes' frequencies explain, ``random`` above the band, None within it."""
    low, high = next((low, high) for below, low, high in BANDS if len(raw) < below)
    ratio = len(packer.compress(raw)) / len(raw)
    return "random" if ratio > high else "repetitive" if ratio < low * entropy(raw) else None


def repeated_words(buf: bytes) -> int:
    """Words of single-space-joined ``buf`` that lie in a 3-word window found twice or more."""
    cut = np.flatnonzero(np.frombuffer(buf, np.uint8) == 32)
    n = len(cut) + 1
    if n < 4:
        return 0
    starts = np.concatenate([[0], cut + 1])[: n - 2].tolist()
    ends = np.concatenate([cut, [len(buf)]])[2:].tolist()
    seen: dict[bytes, int] = {}
    first = [seen.setdefault(buf[s:e], i) for i, (s, e) in enumerate(zip(starts, ends))]
    first = np.array(first)
    if len(seen) == len(first):
        return 0
    hit = np.bincount(first, minlength=len(first))[first] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def base_metrics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    raw = encode(text)
    buf = b" ".join(words := raw.split())
    marks = np.frombuffer(buf, np.uint8)
    chars = int(((marks & 0xC0) != 0x80).sum()) - max(0, len(words) - 1)
    lines = [x for x in raw.split(b"\n") if x.strip(b"\x20\t\n\x0b\x0c\r")]
    return len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(buf)


def broken_band(raw: bytes, packer: zstandard.ZstdCompressor) -> str | None:
    """The verdict of the compression bands on a text that isn't empty: the rule it breaks, if any."""
    if whole := outside(raw, packer):
        return whole
    n = max(1, round(len(raw) / CHUNK))
    if n == 1:
        return None
    cuts = [len(raw) * k // n for k in range(n + 1)]
    out = sum(b - a for a, b in zip(cuts, cuts[1:]) if outside(raw[a:b], packer))
    return "chunks" if out > OUTSIDE * len(raw) else None


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, the base metrics, ``base_failed``, ``kept`` and the ``reason`` why not."""
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = pa.schema([(id_col, pa.int64()), *((c, pa.int64()) for c in counts), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("reason", pa.string())])

    def work(rows: dict) -> dict:
        packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)
        found = [base_metrics(t) for t in rows[text_col]]
        base = ["words" if m[0] < MIN_WORDS else "repeats" if 100 * m[4] > 50 * m[0] else None for m in found]
        reason = [b or broken_band(encode(t), packer) for b, t in zip(base, rows[text_col])]
        return {
            id_col: rows[id_col],
            **{c: [m[k] for m in found] for k, c in enumerate(counts)},
            "base_failed": [b is not None for b in base],
            "kept": [r is None for r in reason],
            "reason": reason,
        }

    kinds = {pa.bool_(): "boolean", pa.int64(): "long", pa.string(): "string"}
    names = ", ".join(f"`{f.name}` {kinds[f.type]}" for f in schema)
    return docs.select(id_col, text_col).mapInArrow(per_row([id_col, text_col], work, schema), names)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base metrics and verdict of every document."""
    return judge(table(spark, sf_dir, "documents"))
