"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text's code points are its first symbols.  An agenda holds the adjacent symbol pairs whose
concatenation is a piece, best score first and leftmost first among equals; the best pair is
merged and its two new neighbours enter the agenda, until it is empty.  Pieces with a space
inside don't exist in such vocabularies (checked on loading), so a text falls into chunks, each
a run of spaces and the non-spaces after it, that are encoded on their own.  All distinct
chunks of an Arrow batch are encoded at once: those of equal length form a matrix of symbols,
from which every row takes the best pair of its agenda in the same step.  Long chunks use a heap.

Each distinct chunk's ids and decoded text are checked against the sentencepiece library,
batch by batch; a difference raises.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import small_batches
from pulsegrid.llm.textkernel import give_back, run_hashes

U = np.uint64
SPACE = "▁"
#: Code points taken at once, and the chunk length from which the heap is used.
SLICE, LONG = 1_000_000, 48
#: Distinct chunks that a task remembers, and how many ids of theirs; beyond either, it starts anew.
KNOWN, KNOWN_IDS = 300_000, 1_500_000
_UNKNOWN = 1 << 20  # symbols for code points without a piece


class MergeVocabulary:
    """Pieces, pair scores and byte pieces of a model given as bytes; only identity normalisation is supported."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        kinds = [(sp.is_control(i), sp.is_unknown(i), sp.is_unused(i), sp.is_byte(i)) for i in range(size)]
        if any(k[2] for k in kinds):
            raise ValueError("vocabularies with unused pieces aren't supported")
        pieces = {sp.id_to_piece(i): i for i in range(size) if not any(kinds[i])}
        if any(SPACE in p.lstrip(SPACE) or len(p) > 1 + len(p.lstrip(SPACE)) and p.strip(SPACE) for p in pieces):
            raise ValueError("vocabularies with spaces inside or several before a piece aren't supported")
        if sp.decode(sp.encode("  ﬁ\t Ab")) != "  ﬁ\t Ab":
            raise ValueError("only models with identity normalisation are supported")
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        symbol = dict(pieces)
        for p in pieces:
            for ch in p:
                symbol.setdefault(ch, _UNKNOWN + ord(ch))
        keys, scores, merged = [], [], []
        for p, i in pieces.items():
            for cut in range(1, len(p)):
                if p[:cut] in symbol and p[cut:] in symbol:
                    keys.append(symbol[p[:cut]] << 32 | symbol[p[cut:]])
                    scores.append(sp.get_score(i))
                    merged.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.scores = np.array(scores, np.float64)[order]
        self.merged = np.array(merged, np.int64)[order]
        self.first = np.arange(0x110000, dtype=np.int64) + _UNKNOWN
        for ch, i in symbol.items():
            if len(ch) == 1:
                self.first[ord(ch)] = i
        by_byte = {sp.id_to_piece(i): i for i in range(size) if kinds[i][3]}
        self.bytes = np.array([by_byte.get(f"<0x{b:02X}>", -1) for b in range(256)], np.int64)
        self.texts = [b"" if kinds[i][0] else " ⁇ ".encode() if kinds[i][1] else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if kinds[i][3] else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(size)]
        self.text_len = np.array([len(t) for t in self.texts], np.int64)
        self.text_off = np.r_[0, np.cumsum(self.text_len)]
        self.text_all = np.frombuffer(b"".join(self.texts), np.uint8)
        self.nothing = np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.known = self.nothing

    def agenda(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, merged piece) of each pair; minus infinity where the pair is no piece."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.scores[at], -np.inf), np.where(hit, self.merged[at], -1)

    def merge_matrix(self, rows: dict[int, tuple[np.ndarray, np.ndarray]], out: list) -> None:
        """rows: length -> (row numbers, symbols).  Each step merges one pair of every row that has one."""
        carried = None
        for n in range(max(rows, default=0), 0, -1):
            if n in rows:
                no, sym = rows[n]
                score, piece = self.agenda(sym[:, :-1], sym[:, 1:])
                if carried is not None:
                    no, sym, score, piece = (np.concatenate(x) for x in zip(carried, (no, sym, score, piece), strict=True))
            elif carried is not None:
                no, sym, score, piece = carried
            else:
                continue
            carried = None
            if n == 1:
                out.append((no, sym))
                continue
            best = score.argmax(axis=1)
            r = np.arange(len(no))
            live = score[r, best] > -np.inf
            if not live.all():
                out.append((no[~live], sym[~live]))
                no, sym, score, piece, best = no[live], sym[live], score[live], piece[live], best[live]
                r = np.arange(len(no))
            if not len(no):
                continue
            sym[r, best] = piece[r, best]
            gone = np.ones(sym.shape, bool)
            gone[r, best + 1] = False
            sym = sym[gone].reshape(len(no), n - 1)
            gone = np.ones(score.shape, bool)
            gone[r, best] = False
            score, piece = score[gone].reshape(len(no), n - 2), piece[gone].reshape(len(no), n - 2)
            for near in (best - 1, best):  # the pairs left and right of the new symbol
                ok = (near >= 0) & (near < n - 2)
                q, p = r[ok], near[ok]
                score[q, p], piece[q, p] = self.agenda(sym[q, p], sym[q, p + 1])
            carried = no, sym, score, piece

    def merge_heap(self, symbols: list[int]) -> list[int]:
        """The same for one long chunk."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        s = np.array(symbols, np.int64)
        score, piece = self.agenda(s[:-1], s[1:])
        heap = [(-score[i], i, symbols[i], symbols[i + 1], int(piece[i])) for i in np.flatnonzero(score > -np.inf).tolist()]
        heapq.heapify(heap)
        known: dict[tuple[int, int], tuple[float, int]] = {}

        def look(a: int, b: int):
            if (a, b) not in known:
                sc, pc = self.agenda(np.array([symbols[a]]), np.array([symbols[b]]))
                return float(sc[0]), int(pc[0])
            return known[a, b]

        while heap:
            _, i, a, b, p = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = p, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n:
                    sc, pc = look(x, y)
                    if pc >= 0:
                        heapq.heappush(heap, (-sc, x, symbols[x], symbols[y], pc))
        return [s for s in symbols if s >= 0]

    def chunk_ids(self, cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks cps[off[i]:off[i+1]], all after another, and their offsets."""
        sym = self.first[cps]
        n = np.diff(off)
        rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        out: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.argsort(n, kind="stable")
        cut = np.flatnonzero(np.diff(n[order])) + 1
        for group in np.split(order, cut):
            if not len(group):
                continue
            size = int(n[group[0]])
            if size > LONG:
                for g in group.tolist():
                    out.append((np.array([g]), np.array([self.merge_heap(sym[off[g] : off[g + 1]].tolist())], np.int64)))
            else:
                rows[size] = group, sym[off[group][:, None] + np.arange(size)]
        self.merge_matrix(rows, out)
        who = np.concatenate([np.repeat(no, m.shape[1]) for no, m in out]) if out else np.zeros(0, np.int64)
        flat = np.concatenate([m.ravel() for _, m in out]) if out else np.zeros(0, np.int64)
        by = np.argsort(who, kind="stable")
        flat, who = flat[by], who[by]
        odd = np.flatnonzero(flat >= _UNKNOWN)
        if len(odd):  # byte fallback, or the unknown piece
            reps = np.ones(len(flat), np.int64)
            spelled = [chr(int(flat[i]) - _UNKNOWN).encode() for i in odd]
            if self.bytes[0] >= 0:
                reps[odd] = [len(x) for x in spelled]
            at = np.r_[0, np.cumsum(reps)]
            wide = np.repeat(flat, reps)
            for i, x in zip(odd, spelled, strict=True):
                wide[at[i] : at[i] + reps[i]] = self.bytes[list(x)] if self.bytes[0] >= 0 else self.unk
            flat, who = wide, np.repeat(who, reps)
        return flat, np.searchsorted(who, np.arange(len(n) + 1))

    def check(self, cps: np.ndarray, off: np.ndarray, ids: np.ndarray, ids_off: np.ndarray) -> None:
        """The library must give the same ids and text for the chunks, up to 64 at a time (it adds the first space itself).

        A chunk of spaces alone ends its group: it would run into the next one's.
        """
        whole = cps.astype("<u4").tobytes().decode("utf-32-le")
        n = len(off) - 1
        groups = np.unique(np.r_[np.arange(0, n, 64), np.flatnonzero(cps[off[1:] - 1] == ord(SPACE)) + 1, n])
        cut, ids_cut = off[groups].tolist(), ids_off[groups].tolist()
        texts = [whole[a + 1 : b].replace(SPACE, " ") for a, b in zip(cut[:-1], cut[1:], strict=True)]
        flat = ids.tolist()
        for t, a, b, theirs in zip(texts, ids_cut[:-1], ids_cut[1:], self.library.encode(texts, num_threads=1), strict=True):
            if t and flat[a:b] != theirs:
                raise ArithmeticError(f"ids differ from the library's for {t!r}: {flat[a:b]} and {theirs}")
        if flat and self.library.decode(flat) != whole[1:].replace(SPACE, " "):
            raise ArithmeticError("the library decodes another text")

    def _segments(self, text: str):
        """The text with its first space, in pieces of bounded size that are cut between chunks."""
        s = SPACE + text.replace(" ", SPACE)
        at = 0
        while len(s) - at > SLICE:
            cut = at + SLICE
            while True:
                cut = s.find(SPACE, cut)
                if cut < 0 or s[cut - 1] != SPACE:
                    break
                cut += 1
            if cut < 0:
                break
            yield s[at:cut]
            at = cut
        yield s[at:]

    def encode(self, texts: list[str], checked: bool = True) -> list[np.ndarray]:
        """Ids of each text without begin and end, as the library's encode gives them."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        waiting: list[tuple[int, str]] = []
        held = 0

        def flush():
            nonlocal held
            if waiting:
                for (i, _), ids in zip(waiting, self._encode_slice([s for _, s in waiting], checked), strict=True):
                    out[i].append(ids)
            waiting.clear()
            held = 0

        for i, t in enumerate(texts):
            for s in self._segments(t) if t else ():
                if held and held + len(s) > SLICE:
                    flush()
                waiting.append((i, s))
                held += len(s)
        flush()
        none = np.zeros(0, np.int64)
        return [np.concatenate(x) if len(x) > 1 else x[0] if x else none for x in out]

    def _encode_slice(self, segments: list[str], checked: bool) -> list[np.ndarray]:
        import pandas as pd

        cps = np.frombuffer("".join(segments).encode("utf-32-le"), "<u4")
        seg_off = np.r_[0, np.cumsum([len(s) for s in segments])]
        space = cps == ord(SPACE)
        begins = space & ~np.r_[False, space[:-1]]
        begins[seg_off[:-1]] = True
        start = np.flatnonzero(begins)
        end = np.r_[start[1:], len(cps)]
        # chunks are told apart by two 64-bit hashes of their bytes
        raw = np.frombuffer("".join(segments).encode(), np.uint8)
        at = np.r_[0, np.cumsum(1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000))]
        one, two = (run_hashes(raw, at[start], at[end], seed) for seed in (1, 2))
        code, seen = pd.factorize(one)
        first = np.empty(len(seen), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        if (two != two[first[code]]).any():
            _, first, code = np.unique(np.stack([one, two], 1), axis=0, return_index=True, return_inverse=True)
            code = code.ravel()
        seen, other = one[first], two[first]
        # chunks met in earlier slices keep their ids; only the others are encoded and checked
        hashes, others, begin, size, pool = self.known
        place = np.minimum(np.searchsorted(hashes, seen), max(len(hashes) - 1, 0))
        old = (hashes[place] == seen) & (others[place] == other) if len(hashes) else np.zeros(len(seen), bool)
        new = np.flatnonzero(~old)
        lens = (end - start)[first[new]]
        u_off = np.r_[0, np.cumsum(lens)]
        chars = cps[np.repeat(start[first[new]] - u_off[:-1], lens) + np.arange(u_off[-1])]
        ids, ids_off = self.chunk_ids(chars, u_off)
        if checked and len(new):
            self.check(chars, u_off, ids, ids_off)
        u_begin, u_size = np.empty(len(seen), np.int64), np.empty(len(seen), np.int64)
        if old.any():
            u_begin[old], u_size[old] = begin[place[old]], size[place[old]]
        u_begin[new], u_size[new] = len(pool) + ids_off[:-1], np.diff(ids_off)
        pool = np.concatenate([pool, ids])
        n = u_size[code]
        at = np.r_[0, np.cumsum(n)]
        flat = pool[np.repeat(u_begin[code] - at[:-1], n) + np.arange(at[-1])]
        if len(hashes) + len(new) <= KNOWN and len(pool) <= KNOWN_IDS:
            hashes, others, begin, size = (np.concatenate(x) for x in ((hashes, seen[new]), (others, other[new]), (begin, u_begin[new]), (size, u_size[new])))
            order = np.argsort(hashes)
            self.known = hashes[order], others[order], begin[order], size[order], pool
        else:
            self.known = self.nothing
        bounds = at[np.searchsorted(start, seg_off)]
        return [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the space that encoding puts first is taken off, begin and end ids have no text."""
        if not len(ids):
            return ""
        n = self.text_len[ids]
        at = np.r_[0, np.cumsum(n)]
        raw = self.text_all[np.repeat(self.text_off[ids] - at[:-1], n) + np.arange(at[-1])].tobytes()
        if raw[:1] == b" ":
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:  # lone byte pieces
            return self.library.decode([int(i) for i in ids])


def _encoded(model, with_ids: bool):
    def run(batches):
        import hashlib

        import pyarrow as pa

        v = None
        for b in batches:
            v = v or MergeVocabulary(model.value)
            texts = [t or "" for t in b.column(1).to_pylist()]
            n, ids_hash, text_hash, all_ids = [], [], [], []
            for ids in v.encode(texts):
                ids = np.r_[v.bos, ids, v.eos]
                n.append(len(ids))
                all_ids.append(ids.astype("<u4"))
                ids_hash.append(hashlib.sha256(all_ids[-1].tobytes()).hexdigest())
                text_hash.append(hashlib.sha256(v.decode(ids).encode()).hexdigest())
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                off = np.r_[0, np.cumsum(n)]
                flat = np.concatenate(all_ids).astype(np.int32) if all_ids else np.zeros(0, np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)
            give_back()

    return run


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]) for each row: ids with begin and end, and the digest of the text they decode to.

    Null and empty texts have the begin and end ids only.  Repeated rows and null ids pass
    through; other columns are ignored; texts are never cut.  A table without rows gives none.
    """
    small_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string")).mapInArrow(_encoded(model, with_ids), schema)
    return out.withColumnRenamed("id", id_col)


def decode_ids(tokens: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """tokens with a column decoded_text: the text of each row's ids; null ids give null."""
    with open(model_path, "rb") as f:
        model = tokens.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def text_of(ids):
        v = MergeVocabulary(model.value)
        return ids.map(lambda x: None if x is None else v.decode(np.asarray(x, np.int64)))

    return tokens.withColumn("decoded_text", text_of(ids_col))
