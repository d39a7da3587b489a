"""Secret scans: rule matches, and sliding-window Shannon entropy per character class.

Candidate strings are maximal runs of a class's characters.  A window slides over each; its
entropy follows from counts that change by one character at a time: with
S = sum(c * log2 c), H = log2(w) - S / w.  Windows at or above the class's threshold are
merged to spans, which an allow-list may suppress.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import small_batches
from pulsegrid.llm.textkernel import runs_of, sliced, utf8

# The base rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class CharClass:
    """A class of characters, the window and the entropy in bits from which a window counts."""

    name: str
    characters: str
    window: int = 20
    bits: float = 3.9
    needs_digit: bool = True


CLASSES = (
    CharClass("hex", "0123456789abcdefABCDEF", 20, 3.0),
    CharClass("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", 20, 3.8),
)

#: Spans that match one of these whole aren't reported.
ALLOW = (
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),  # UUIDs
    re.compile(r"[0-9]+"),
    re.compile(r"(?i)(0123456789(abcdef)?|abcdefghijklmnopqrstuvwxyz|[+/=_-])+"),
    re.compile(r"(?i)(sha(1|256|384|512)|md5)-.*"),
)


#: The stretch of letters and digits around one of these words isn't reported; what stands beside it is.
ALLOW_WORDS = re.compile(r"(?i)example|sample|placeholder|changeme|your[_-]?(?:key|token|secret)")
NO_WORD = re.compile(r"[^0-9A-Za-z]|$")


def entropy_windows(s: str, w: int, bits: float) -> list[tuple[int, int]]:
    """Merged spans of the windows of w characters whose entropy is at least `bits`."""
    n = len(s)
    if n < w:
        return []
    weight = [0.0] + [c * math.log2(c) for c in range(1, w + 2)]
    most = (math.log2(w) - bits) * w + 1e-9  # the sum a window may have
    counts: dict[str, int] = {}
    total = 0.0
    out: list[tuple[int, int]] = []
    for i, ch in enumerate(s):
        c = counts.get(ch, 0)
        total += weight[c + 1] - weight[c]
        counts[ch] = c + 1
        if i >= w:
            c = counts[s[i - w]]
            total += weight[c - 1] - weight[c]
            counts[s[i - w]] = c - 1
        if i >= w - 1 and total <= most:
            a = i - w + 1
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((a, i + 1))
    return out


def entropy_spans(candidate: str, cls: CharClass, allow=ALLOW) -> list[tuple[int, int]]:
    """The class's spans in one candidate string, outside allowed words, that no allow-list entry, on the span or the whole string, covers."""
    if any(p.fullmatch(candidate) for p in allow):
        return []
    found, at = [], 0
    while at < len(candidate):
        word = ALLOW_WORDS.search(candidate, at)
        a = z = len(candidate)
        if word:
            a, z = word.start(), NO_WORD.search(candidate, word.end()).start()
            while a > at and candidate[a - 1].isalnum():
                a -= 1
        found += [(at + s, at + e) for s, e in entropy_windows(candidate[at:a], cls.window, cls.bits)]
        at = z
    return [(a, z) for a, z in found if (not cls.needs_digit or any(c.isdigit() for c in candidate[a:z])) and not any(p.fullmatch(candidate[a:z]) for p in allow)]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    low = text.lower()
    out = []
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by start, then kind as listed, then end."""
    return ",".join(f"{k}:{a}:{z}" for k, a, z in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def _members(characters: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(characters.encode())] = True
    return t


def _scan(classes, allow):
    def run(batches):
        import pyarrow as pa

        low_hex = _members("0123456789abcdef")
        tables = [(c, _members(c.characters)) for c in classes]
        for b in sliced(batches, 1):
            raw, off = utf8(b.column(1))
            texts = [t or "" for t in b.column(1).to_pylist()]
            per: dict[int, list[tuple[str, int, int]]] = {}
            runs: dict[int, list[tuple[int, int, CharClass | None]]] = {}
            for cls, member, least in [(None, low_hex, MIN_HEX), *((c, t, c.window) for c, t in tables)]:
                s, e = runs_of(member, raw, off, least)
                for d, a, z in zip((np.searchsorted(off, s, "right") - 1).tolist(), s.tolist(), e.tolist(), strict=True):
                    runs.setdefault(d, []).append((a, z, cls))
            for d, found in runs.items():
                part = raw[off[d] : off[d + 1]]
                index = np.cumsum((part & 0xC0) != 0x80)  # code points up to each byte
                spans: list[tuple[str, int, int]] = []
                entropy: list[tuple[int, int]] = []
                for a, z, cls in found:
                    at = int(index[a - off[d]]) - 1
                    if cls is None:
                        spans.append(("hex", at, at + z - a))
                    else:
                        entropy += [(at + x, at + y) for x, y in entropy_spans(raw[a:z].tobytes().decode(), cls, allow)]
                per[d] = spans + [("entropy", *x) for x in _merged(entropy)]
            n = {k: [] for k in KINDS}
            base, both = [], []
            for d, t in enumerate(texts):
                spans = base_spans(t) + per.get(d, [])
                for k in KINDS:
                    n[k].append(sum(s[0] == k for s in spans))
                base.append(hashlib.sha256(joined([s for s in spans if s[0] != "entropy"]).encode()).hexdigest())
                both.append(joined(spans))
            cols = [b.column(0), *(pa.array(n[k], pa.int64()) for k in KINDS), pa.array(base, pa.string()), pa.array(both, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])

    return run


def scan_secrets(docs: DataFrame, classes: tuple[CharClass, ...] = CLASSES, allow=ALLOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans) for each row.

    base_sha256 is the digest of the rule spans, spans lists all of them, both as
    kind:start:end by start.  A null text counts as empty and has no spans; null ids and
    repeated rows pass through; other columns are ignored; texts are never cut.
    """
    small_batches(docs.sparkSession)
    schema = "id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string")).mapInArrow(_scan(classes, allow), schema)
    return out.withColumnRenamed("id", id_col)
