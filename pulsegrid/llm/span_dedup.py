"""Substring deduplication by sliding sentence spans.

Every run of `span` consecutive sentences, and every pair of enough words, is hashed by its words (122 bits), the hashes are counted over all documents, and each sentence that lies in
a repeated run which isn't the run's first occurrence (smallest document id, then position) is
taken out of its text.

A sentence ends at a line break, at . ! ? before white space (closing quotes, brackets and
symbols may stand between), and after a full-width full stop, exclamation or question mark
with the closing quotes and brackets that follow it; its words are runs of ASCII letters and digits
and non-ASCII characters, A-Z in lower case, so case and punctuation don't hide a repeat.
Segments without words belong to the sentence before them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import materialize, small_batches, small_side
from pulsegrid.llm.textkernel import SpanHasher, WordHasher, sliced, utf8

U = np.uint64
#: ASCII that may stand between a stop and the blank after it: all punctuation but , ; : and what opens.
CLOSING = np.isin(np.arange(256), np.frombuffer(b"\"#$%&')*+-/=>\\]^_`|}~@", np.uint8))
#: Closing quotes and brackets of three bytes.
WIDE_CLOSING = [int.from_bytes(c.encode(), "big") for c in "’”›」』】〉》〕）］｝＂＇"]
#: Merged runs up to which the table of removals is broadcast; beyond it the join shuffles.
BROADCAST_POSITIONS = 4_000_000


def _cuts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where a new sentence starts, whatever the text."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    stop = (raw == 46) | (raw == 33) | (raw == 63)
    cut = (raw == 10) | (raw == 13)
    wide = np.zeros(n, bool)
    closing = CLOSING[raw]
    if n > 2:
        a, b, c = raw[:-2], raw[1:-1], raw[2:]
        wide[2:] = ((a == 0xE3) & (b == 0x80) & (c == 0x82)) | ((a == 0xEF) & (b == 0xBC) & ((c == 0x81) | (c == 0x9F)))
        three = np.isin(a.astype(np.int32) << 16 | b.astype(np.int32) << 8 | c, WIDE_CLOSING)
        for j in range(3):
            closing[j : n - 2 + j] |= three
    if n > 1:
        two = (raw[:-1] == 0xC2) & (raw[1:] == 0xBB)
        closing[:-1] |= two
        closing[1:] |= two
    # the last stop, and the last byte that is neither a stop nor closing, up to each byte; texts don't reach into one another
    at = np.arange(n)
    other = np.where(stop | wide | closing, -1, at)
    begin = off[:-1][off[:-1] < n]
    other[begin] = np.maximum(other[begin], begin - 1)
    other = np.maximum.accumulate(other)
    ended = np.maximum.accumulate(np.where(stop, at, -1)) > other
    cut[:-1] |= ended[:-1] & blank[1:]
    ended = np.maximum.accumulate(np.where(wide, at, -1)) > other
    cut |= ended & ~np.r_[ended[1:], False]
    return np.flatnonzero(cut) + 1


class SentenceHasher:
    def __init__(self):
        self.words = WordHasher("alnum")

    def __call__(self, raw: np.ndarray, off: np.ndarray):
        """(hashes of all words, and of each sentence the number of words and the first byte, offsets of each text's sentences)."""
        words, word_off, start, _ = self.words(raw, off)
        if not len(words):
            z = np.zeros(0, np.int64)
            return words, z, z, np.zeros(len(off), np.int64)
        owner = np.repeat(np.arange(len(off) - 1), np.diff(word_off))
        cuts = _cuts(raw, off)
        part = np.searchsorted(cuts, start, "right")
        first = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])])
        last = np.r_[first[1:], len(words)]
        begin = np.maximum(np.r_[0, cuts][part[first]], off[owner[first]])
        return words, last - first, begin, np.searchsorted(first, word_off)


def _packed(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """First and end sentence of runs as one number, in order of the first."""
    return first << 32 | end


def _unpacked(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return run >> 32, run & 0xFFFFFFFF


def _runs(n_words: np.ndarray, off: np.ndarray, span: int, min_words: int, long_words: int | None, pair_words: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First and end sentence of the shortest runs, from each sentence on and up to each, and the long sentences and pairs, if these are asked for; a text of fewer than span sentences is one run at most."""
    total = np.r_[0, np.cumsum(n_words)]
    one = np.arange(len(n_words))
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    lo, hi = off[:-1][owner], off[1:][owner]
    least = np.minimum(span, hi - lo)
    after = np.maximum(np.searchsorted(total, total[one] + min_words), one + least)
    before = np.minimum(np.searchsorted(total, total[one + 1] - min_words, "right") - 1, one + 1 - least)
    on, up = after <= hi, before >= lo
    alone = np.flatnonzero(n_words >= long_words) if long_words else one[:0]
    pair = np.flatnonzero((one + 2 <= hi) & (total[np.minimum(one + 2, len(n_words))] - total[one] >= pair_words)) if pair_words else one[:0]
    key = np.unique(np.r_[_packed(one[on], after[on]), _packed(before[up], one[up] + 1), _packed(alone, alone + 1), _packed(pair, pair + 2)])
    return _unpacked(key)


def _span_rows(span: int, min_words: int, long_words: int | None, pair_words: int | None):
    def run(batches):
        import pyarrow as pa

        hasher, spans = SentenceHasher(), SpanHasher()
        for b in sliced(batches, 1):
            words, n_words, _, off = hasher(*utf8(b.column(1)))
            first, end = _runs(n_words, off, span, min_words, long_words, pair_words)
            word = np.r_[0, np.cumsum(n_words)]
            h, g = spans(words, word[first], word[end])
            doc = np.searchsorted(off, first, "right") - 1
            key = _packed(first - off[doc], end - off[doc])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(key), pa.array(h.view(np.int64)), pa.array(g.view(np.int64))], names=["id", "run", "h", "g"])

    return run


def _merged(batches):
    """Each row's runs with those that touch or overlap made one."""
    import pyarrow as pa

    for b in batches:
        runs = b.column(1)
        size = runs.value_lengths().to_numpy(zero_copy_only=False)
        first, end = _unpacked(runs.flatten().to_numpy(zero_copy_only=False))
        shift = np.repeat(np.arange(len(size)), size) << 32  # rows stay apart
        order = np.argsort(first + shift)
        first, end = (first + shift)[order], np.maximum.accumulate((end + shift)[order])
        fresh = np.flatnonzero(np.r_[True, first[1:] > end[:-1]][: len(first)])
        last = np.r_[fresh[1:], len(first)][: len(fresh)] - 1
        off = np.searchsorted(first[fresh] >> 32, np.arange(len(size) + 1)).astype(np.int32)
        out = pa.array(_packed(first[fresh] & 0xFFFFFFFF, end[last] & 0xFFFFFFFF))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(off), out)], names=["id", "gone"])


def _cleaned(batches):
    import pyarrow as pa

    hasher = SentenceHasher()
    for b in sliced(batches, 1):
        raw, off = utf8(b.column(1))
        _, n_words, begin, s_off = hasher(raw, off)
        whole = raw.tobytes()
        n_sent, n_gone, words_gone, texts = [], [], [], []
        for i, (t, gone) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
            a, z = int(s_off[i]), int(s_off[i + 1])
            n_sent.append(z - a)
            if not gone:
                n_gone.append(0)
                words_gone.append(0)
                texts.append(t)
                continue
            drop = np.zeros(z - a, bool)
            for p in gone:
                drop[p >> 32 : p & 0xFFFFFFFF] = True
            edges = np.r_[begin[a:z], off[i + 1]]
            edges[0] = off[i]
            n_gone.append(int(drop.sum()))
            words_gone.append(int(n_words[a:z][drop].sum()))
            texts.append(b"".join(whole[edges[j] : edges[j + 1]] for j in np.flatnonzero(~drop)).decode())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_sent, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(words_gone, pa.int64()), pa.array(texts, pa.string())], names=["id", "n_sentences", "n_removed", "n_words_removed", "text"])


def remove_repeated_spans(docs: DataFrame, span: int = 3, min_words: int = 0, id_col: str = "doc_id", text_col: str = "text", long_words: int | None = None, pair_words: int | None = None) -> DataFrame:
    """One row per input row: (id, n_sentences, n_removed, n_words_removed, text), text without its repeated sentences.

    Every run of `span` sentences is hashed; with min_words, runs of fewer words are lengthened until
    they have as many.  Two consecutive sentences of pair_words words together are a run as well: a passage
    that begins and ends inside sentences may hold no more whole ones.  A sentence of long_words words
    is a run alone; a text of fewer than `span` sentences is one run.  Null and empty texts come back as they
    are, with zeros.  Rows with a null id are left alone and are no one's first occurrence.
    Rows that repeat an id are taken as one document: equal rows keep the same sentences.
    Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    runs = base.where("id is not null").mapInArrow(_span_rows(span, min_words, long_words, pair_words), "id long, run long, h long, g long")
    often = runs.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(F.struct("id", "run")).alias("first"))
    often = materialize(often.where("n > 1").select("h", "g", F.col("first.id").alias("first_id"), F.col("first.run").alias("first_run")), "repeated")
    gone = runs.join(small_side(often, 1_500_000), ["h", "g"]).where("id != first_id or run != first_run")
    gone = gone.groupBy("id").agg(F.collect_set("run").alias("gone"))
    gone = materialize(gone.mapInArrow(_merged, "id long, gone array<long>"), "removals")
    size = gone.agg(F.sum(F.size("gone"))).first()[0] or 0
    joined = base.join(F.broadcast(gone) if size <= BROADCAST_POSITIONS else gone, "id", "left")
    out = joined.select("id", "text", "gone").mapInArrow(_cleaned, "id long, n_sentences long, n_removed long, n_words_removed long, text string")
    return out.withColumnRenamed("id", id_col)
