"""Evaluation texts that leak into a corpus.

Method: a broadcast hash set of the normalised n-grams of all test items; one scan over the corpus hashes every window of
every text and looks it up; hits are verified word by word; spans or documents can then be removed. Nothing is shuffled but
the found pairs.

Windows are of ``WINDOW`` letters and digits rather than of words: punctuation, spacing, quoting and markup can join words
(``a.b`` to ``ab``) and split them (``a . b``), but leave the run of letters and digits as it is. With at most one word in six
changed, a run of 25 words holds at least five unchanged ones in a row, so a leaked passage always has hits.

Defined results: null and empty texts reveal nothing; a null id is kept as null; items without words reveal nothing; items
with equal texts are each reported; repeated documents are each reported. The hash set is built for ``BLOCK_LETTERS`` of
items at a time, which bounds what is broadcast whatever the number of items.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..plans import cut

WINDOW = 14
MIN_WORDS = 25
CHANGED = 6  # at most one word in so many
BLOCK_LETTERS = 4_000_000
#: Wording is stock where STOCK_WORDS words in a row stand in more than STOCK_SHARE of all items (and in STOCK_LEAST at least).
STOCK_WORDS, STOCK_SHARE, STOCK_LEAST = 10, 0.03, 5
#: A run must hold so many words that aren't stock wording.
MIN_OWN = 20
#: So many hits on nearby diagonals and letters in a chain are asked for at most; an item whose run of MIN_WORDS words can
#: have less with so few changes (``least_hits``) asks for less.
MIN_HITS, MIN_LETTERS, _BAND = 24, 50, 48
_GAP = 90  # letters between two matching stretches of one passage

_TAG, _ENTITY, _NON = re.compile(r"</?[A-Za-z][^<>]*>"), re.compile(r"&#?\w{1,10};"), re.compile(r"[\W_]+")
_NO_LETTERS = bytes(c for c in range(256) if not (c < 128 and chr(c).isalnum()))
#: Items of more words than this skip ``may_hold`` (its table has a column per word) and are verified right away.
_TABLE_WORDS = 2000
_FAR = 10_000_000


def letters(text: str) -> str:
    """The letters and digits of a text, in lower case, without markup."""
    if "<" in text:
        text = _TAG.sub("", text)
    if "&" in text:
        text = _ENTITY.sub("", text)
    if text.isascii():
        return text.lower().encode().translate(None, _NO_LETTERS).decode()
    return _NON.sub("", unicodedata.normalize("NFKC", text).lower())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def window_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of the ``WINDOW`` codes from each position on."""
    if len(codes) < WINDOW:
        return np.zeros(0, np.uint64)
    b = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        h1 = (codes + np.uint64(1)) * b
        h2 = h1[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + (h1[1:] ^ (h1[1:] >> np.uint64(29)))
        h4 = h2[:-2] * np.uint64(0x165667B19E3779F9) + (h2[2:] ^ (h2[2:] >> np.uint64(31)))
        h8 = h4[:-4] * np.uint64(0xD6E8FEB86659FD93) + (h4[4:] ^ (h4[4:] >> np.uint64(32)))
        step = WINDOW - 8
        h = h8[:-step] * np.uint64(0xA0761D6478BD642F) + (h8[step:] ^ (h8[step:] >> np.uint64(30)))
    return h ^ (h >> np.uint64(33))


class Item:
    """A test item: its letters, the word each letter belongs to, and which words are stock wording."""

    def __init__(self, item_id: object, text: str) -> None:
        self.id = item_id
        self.words = [w for w in (letters(x) for x in text.split()) if w]
        self.text = "".join(self.words)
        self.starts = np.cumsum([0, *map(len, self.words)])
        self.begins = self.starts.tolist()
        self.stock = np.zeros(len(self.words), bool)
        self.hits = least_hits(self.starts)
        self.letters = min(MIN_LETTERS, self.hits + WINDOW - 1)


def least_hits(starts: np.ndarray) -> int:
    """The fewest windows that stay whole in a run of MIN_WORDS words, whichever of its words are changed; 1 at least."""
    runs = len(starts) - MIN_WORDS
    if runs < 1:
        return 1
    changes, least = MIN_WORDS // CHANGED, MIN_HITS
    for lo in range(0, runs, 20_000):
        hi = min(lo + 20_000, runs)
        # fewest[c]: windows before word j, which is the c-th changed one.
        at = [starts[lo + j : hi + j] for j in range(MIN_WORDS + 1)]
        fewest: list[dict[int, np.ndarray]] = [{} for _ in range(changes + 2)]
        for j in range(MIN_WORDS + 1):
            fewest[1][j] = np.maximum(at[j] - at[0] - (WINDOW - 1), 0)
            for i in range(j):
                part = np.maximum(at[j] - at[i + 1] - (WINDOW - 1), 0)
                for c in range(1, changes + 1):
                    if i in fewest[c]:
                        n = fewest[c][i] + part
                        fewest[c + 1][j] = np.minimum(fewest[c + 1][j], n) if j in fewest[c + 1] else n
        least = min(least, int(fewest[changes + 1][MIN_WORDS].min()))
    return max(least, 1)


def _runs_of(words: list[str]) -> list[str]:
    return [" ".join(words[k : k + STOCK_WORDS]) for k in range(len(words) - STOCK_WORDS + 1)]


def stock_runs(items: list[Item]) -> set[str]:
    """The runs of words that are stock wording; items with equal words don't make theirs stock."""
    each = {i.text: set(_runs_of(i.words)) for i in items}
    seen = Counter(r for runs in each.values() for r in runs)
    least = max(STOCK_LEAST, STOCK_SHARE * len(each))
    return {r for r, n in seen.items() if n > least}


def mark_stock(items: list[Item], runs: set[str] | None = None) -> None:
    runs = stock_runs(items) if runs is None else runs
    for i in items:
        for k, r in enumerate(_runs_of(i.words)):
            if r in runs:
                i.stock[k : k + STOCK_WORDS] = True


class Index:
    """The hash set of a block of items."""

    def __init__(self, items: list[Item]) -> None:
        self.items = items
        hashes, which, at, own = [], [], [], []
        for n, i in enumerate(items):
            h = window_hashes(_codes(i.text))
            hashes.append(h), which.append(np.full(len(h), n, np.int32)), at.append(np.arange(len(h), dtype=np.int32))
            # Only windows made of stock words alone are no sign of a leak.
            stock = np.cumsum([0, *np.repeat(i.stock, np.diff(i.starts))])
            own.append(stock[WINDOW:] - stock[:-WINDOW] < WINDOW if len(h) else np.zeros(0, bool))
        h = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        order = np.argsort(h, kind="stable")
        self.hashes, self.which, self.at = h[order], np.concatenate([*which, np.zeros(0, np.int32)])[order], np.concatenate([*at, np.zeros(0, np.int32)])[order]
        self.own = np.concatenate([*own, np.zeros(0, bool)])[order]
        self.least = np.array([i.hits for i in items], np.int64)
        # The words of all items in one row, for ``may_hold``.
        self.sizes = np.array([len(i.words) for i in items], np.int64)
        self.bases = np.concatenate([[0], np.cumsum([len(i.text) for i in items])]).astype(np.int64)
        self.firsts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.starts = np.concatenate([*[i.starts[:-1] + b for i, b in zip(items, self.bases)], self.bases[-1:]]).astype(np.int64)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.hashes >> np.uint64(42)).astype(np.int64)] = True
        unique, start, count = np.unique(self.hashes, return_index=True, return_counts=True)
        self.unique, self.start, self.count = unique, start, count

    def passages(self, texts: list[str]) -> Iterator[tuple[int, Item, int, int]]:
        """(number of the text, item, first letter, end letter) of each leaked passage's best run; letters as ``letters`` gives them."""
        streams = [letters(t) for t in texts]
        joined = _codes("\x00".join(streams))
        h = window_hashes(joined)
        pos = np.flatnonzero(self.bits[(h >> np.uint64(42)).astype(np.int64)])
        if not len(pos) or not len(self.unique):
            return
        k = np.searchsorted(self.unique, h[pos])
        k[k == len(self.unique)] = 0
        good = self.unique[k] == h[pos]
        pos, k = pos[good], k[good]
        ends = np.cumsum([len(s) + 1 for s in streams])
        doc = np.searchsorted(ends, pos, side="right")
        first = ends - np.array([len(s) + 1 for s in streams])
        n = self.count[k]
        rows = np.repeat(self.start[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        docs, spots = np.repeat(doc, n), np.repeat(pos - first[doc], n)
        which, at, own = self.which[rows], self.at[rows], self.own[rows]
        pair = docs.astype(np.int64) * len(self.items) + which
        # Hits in each band of diagonals, and in the next one with it.
        band = pair * (1 << 20) + ((spots - at) // _BAND + (1 << 16))
        bands, size = np.unique(band, return_counts=True)
        beside = np.searchsorted(bands, bands + 1)
        both = size + np.where((beside < len(bands)) & (bands[np.minimum(beside, len(bands) - 1)] == bands + 1), size[np.minimum(beside, len(bands) - 1)], 0)
        wanted = np.intersect1d(np.unique(bands[both >= self.least[(bands >> 20) % max(1, len(self.items))]] >> 20), np.unique(pair[own]))
        if not len(wanted):
            return
        chosen = np.isin(pair, wanted)
        pair, spots, at = pair[chosen], spots[chosen], at[chosen]
        # Stretches of hits on one diagonal, of all pairs at once.
        order = np.lexsort((spots, spots - at, pair))
        pair, spots, at = pair[order], spots[order], at[order]
        cuts = np.flatnonzero((np.diff(pair) != 0) | (np.diff(spots - at) != 0) | (np.diff(spots) != 1)) + 1
        begin, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(pair)]])
        pair, p, q, size = pair[begin], spots[begin], at[begin], end - begin + WINDOW - 1
        wanted = wanted[self.may_hold(wanted, pair, q, size)]
        lows, highs = np.searchsorted(pair, wanted), np.searchsorted(pair, wanted, side="right")
        for w, lo, hi in zip(wanted.tolist(), lows.tolist(), highs.tolist()):
            d, item = w // len(self.items), self.items[w % len(self.items)]
            if run := verify(item, streams[d], sorted(zip(p[lo:hi].tolist(), q[lo:hi].tolist(), size[lo:hi].tolist()))):
                yield d, item, *run

    def may_hold(self, wanted: np.ndarray, pair: np.ndarray, q: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the stretches of each wanted pair leave room for a leaked run.

        Words that no stretch covers whole hold edits: where a stretch ends a word was changed or put in, and so it was wherever
        ``WINDOW`` letters go by without a hit. The fewest edits that can be, counted along the item, are a bound from below;
        pairs that are above the allowed number everywhere need no further look.
        """
        out = np.ones(len(wanted), bool)
        item = wanted % len(self.items)
        n = self.sizes[item]
        out[n < MIN_WORDS] = False
        small = np.flatnonzero(out & (n <= _TABLE_WORDS))
        small = small[np.argsort(n[small], kind="stable")]
        which = pair % len(self.items)
        # The words that each stretch covers whole, counted in the item.
        w0 = np.searchsorted(self.starts, self.bases[which] + q) - self.firsts[which]
        w1 = np.searchsorted(self.starts, self.bases[which] + q + size, side="right") - 1 - self.firsts[which]
        row = np.searchsorted(wanted, pair)
        place = np.full(len(wanted), -1)
        for lo in range(0, len(small), 4096):
            some = small[lo : lo + 4096]
            most = int(n[some].max())
            place[:] = -1
            place[some] = np.arange(len(some))
            mine = place[row] >= 0
            r, a, b = place[row[mine]], w0[mine], w1[mine]
            r, a, b = r[b > a], a[b > a], b[b > a]
            covered = np.cumsum(np.bincount(a * len(some) + r, minlength=(most + 1) * len(some)).reshape(most + 1, -1) - np.bincount(b * len(some) + r, minlength=(most + 1) * len(some)).reshape(most + 1, -1), 0)[:most] > 0
            index = np.minimum(self.firsts[item[some]][None] + np.arange(most)[:, None], len(self.starts) - 2)
            length = self.starts[index + 1] - self.starts[index]
            words = np.arange(most)[:, None]
            # The fewest edits up to each word, counted from the item's beginning.
            upto = np.zeros((most, len(some)), np.int32)
            edits, loose, inside = np.zeros(len(some), np.int32), np.zeros(len(some), np.int32), np.zeros(len(some), bool)
            for w in range(most):
                c, l = covered[w], length[w]
                forced = ~c & (~inside | (loose + l >= WINDOW))
                edits = edits + (forced | (c & (loose > 0)))
                loose = np.where(c | forced, 0, loose + l)
                inside = ~c
                upto[w] = edits
            # For a run that starts at a word that isn't covered, those up to the next covered one are counted from there backwards.
            start = np.zeros((most, len(some)), np.int32)
            far, extra = np.full(len(some), -_FAR, np.int32), np.zeros(len(some), np.int32)
            loose, inside = np.zeros(len(some), np.int32), np.zeros(len(some), bool)
            for w in range(most - 1, -1, -1):
                c, l = covered[w], length[w]
                forced = ~c & (~inside | (loose + l >= WINDOW))
                extra = np.where(c, 0, extra + forced)
                loose = np.where(c | forced, 0, loose + l)
                inside = ~c
                far = np.where(c, upto[w], far)
                start[w] = far - extra
            best = np.maximum.accumulate(CHANGED * start - words, 0)
            good = ((CHANGED * upto - words - 1)[MIN_WORDS - 1 :] <= best[: most - MIN_WORDS + 1]) & (words < n[some])[MIN_WORDS - 1 :]
            good = good.any(0)
            out[some] = good
        return out


def verify(item: Item, stream: str, parts: list[tuple[int, int, int]]) -> tuple[int, int] | None:
    """The span in the text's letters of a run of the item's words that is long and unchanged enough, or None.

    parts: the stretches (at in the text, at in the item, letters) in which both agree, in order.
    """
    if len(item.words) < MIN_WORDS:
        return None
    # Chains of stretches that go on in both texts; the best one by letters.
    best: list[tuple[int, int]] = []
    longest = max((n for _, _, n in parts), default=0)
    for j, (p, q, n) in enumerate(parts):
        top = (n, -1)
        for i in range(j - 1, -1, -1):
            pp, qq, nn = parts[i]
            if p - pp > _GAP + longest:
                break
            dp, dq = p - pp - nn, q - qq - nn
            overlap = max(0, -dp, -dq)
            if overlap < n and p > pp and q > qq and dp <= _GAP and dq <= _GAP and abs(dp - dq) <= _GAP // 2 and best[i][0] + n - overlap > top[0]:
                top = (best[i][0] + n - overlap, i)
        best.append(top)
    tried: set[int] = set()
    for j in sorted(range(len(parts)), key=lambda j: -best[j][0]):
        if best[j][0] < item.letters:
            break
        if j in tried:  # the beginning of a chain already tried
            continue
        chain = []
        while j >= 0:
            tried.add(j)
            chain.append(parts[j])
            j = best[j][1]
        if run := _longest(item, stream, chain[::-1]):
            return run
    return None


def _longest(item: Item, stream: str, chain: list[tuple[int, int, int]]) -> tuple[int, int] | None:
    words, starts = item.words, item.begins
    n = len(words)
    where: dict[int, int] = {}  # at which letter of the text each kept word stands
    for p, q, length in chain:
        for w in range(bisect_left(starts, q), bisect_right(starts, q + length) - 1):
            where.setdefault(w, p + starts[w] - q)
    if not where:
        return None
    kept = sorted(where)
    # Short unchanged words between the stretches, and before and after them.
    for a, b in zip(kept, kept[1:]):
        at = where[a] + len(words[a])
        for w in range(a + 1, b):
            found = stream.find(words[w], at, max(0, where[b]))
            if found >= 0 and found - at <= 12 * (w - a):
                where[w] = found
                at = found + len(words[w])
    at = where[kept[-1]] + len(words[kept[-1]])
    for w in range(kept[-1] + 1, min(n, kept[-1] + 14)):
        found = stream.find(words[w], at, at + len(words[w]) + 10)
        if found >= 0:
            where[w] = found
            at = found + len(words[w])
    at = where[kept[0]]
    for w in range(kept[0] - 1, max(-1, kept[0] - 14), -1):
        found = stream.rfind(words[w], max(0, at - len(words[w]) - 10), at)
        if found >= 0:
            where[w] = found
            at = found
    if len(where) * CHANGED < MIN_WORDS * (CHANGED - 1):
        return None
    kept = np.array(sorted(where))
    at = np.array([where[w] for w in kept.tolist()])
    # Words put in between count as changes; a word has about six letters. In sixths of a word, from 0.75 words on.
    extra = np.diff(at) - (item.starts[1:] - item.starts[:-1])[kept[:-1]] - 6 * (np.diff(kept) - 1)
    changes = CHANGED * (kept - np.arange(len(kept)))
    changes[1:] += CHANGED * np.cumsum(np.where(extra >= 5, extra, 0)) // 6
    own = np.cumsum(np.append(0, ~item.stock))
    # From each first word the last one with few enough changes: the run holds the most words and the most of its own.
    last = np.searchsorted(np.minimum.accumulate((changes - kept - 1)[::-1])[::-1], changes - kept, side="right") - 1
    ends = kept[np.maximum(last, 0)]
    sizes = np.where((last >= 0) & (own[ends + 1] - own[kept] >= MIN_OWN), ends - kept + 1, 0)
    k = int(np.argmax(sizes))
    return (int(at[k]), where[int(ends[k])] + len(words[ends[k]])) if sizes[k] >= MIN_WORDS else None


def _blocks(items: Iterator[Item]) -> Iterator[list[Item]]:
    block, n = [], 0
    for i in items:
        block.append(i)
        n += len(i.text)
        if n > BLOCK_LETTERS:
            yield block
            block, n = [], 0
    if block:
        yield block


def _normal_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = [" ".join(w for w in map(letters, (t or "").split()) if w) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.string())], ["item_id", "words"])


def _stock_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([r for t in b.column(0).to_pylist() for r in set(_runs_of(t.split(" ")))], pa.string())], ["run"])


_indexes: dict[str, Index] = {}


def _index_of(name: str, shared) -> Index:  # noqa: ANN001
    """The index of a block, built once per worker process."""
    if name not in _indexes:
        _indexes.clear()
        _indexes[name] = Index(shared.value)
    return _indexes[name]


def find_leaks(documents: DataFrame, eval_items: DataFrame, spans: bool = False) -> DataFrame:
    """(doc_id, item_id), and with ``spans`` also where the passage stands (start, end in the text's letters).

    Items with equal words are looked for once. Which wording is stock is counted in Spark; there are at most (words per item) /
    STOCK_SHARE such runs. The driver reads the items one block at a time, each block is one scan over the documents.
    """
    spark = documents.sparkSession
    id_type = documents.schema["doc_id"].dataType.simpleString()
    item_type = eval_items.schema["item_id"].dataType.simpleString()
    kind = to_arrow_type(eval_items.schema["item_id"].dataType)
    ddl = f"doc_id {id_type}, item_id {item_type}" + (", start_letter bigint, end_letter bigint" if spans else "")
    normal = cut(eval_items.select("item_id", "text").mapInArrow(_normal_items, f"item_id {item_type}, words string").filter("words <> ''"))
    single = cut(normal.groupBy("words").agg(F.min("item_id").alias("item_id"), F.count("*").alias("same")))
    size = single.agg(F.count("*").alias("texts"), F.max("same").alias("same")).first()
    least = max(STOCK_LEAST, STOCK_SHARE * size.texts)
    runs = {r.run for r in single.select("words").mapInArrow(_stock_runs, "run string").groupBy("run").agg(F.count("*").alias("n")).filter(F.col("n") > least).select("run").toLocalIterator()}

    def made() -> Iterator[Item]:
        for r in single.select("item_id", "words").toLocalIterator():
            i = Item(r.item_id, r.words)
            mark_stock([i], runs)
            yield i

    out = None
    for block in _blocks(made()) if size.texts else [[]]:
        shared, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            index = _index_of(name, shared)
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1).to_pylist()
                for a in range(0, len(texts), 2000):
                    found = [(d, i.id, *at) for d, i, *at in index.passages([t or "" for t in texts[a : a + 2000]])]
                    cols = [ids.take(pa.array([a + f[0] for f in found], pa.int64())), pa.array([f[1] for f in found], kind)]
                    if spans:
                        cols += [pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.int64())]
                    if found:
                        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "start_letter", "end_letter"][: len(cols)])

        part = documents.select("doc_id", "text").filter("text is not null").mapInArrow(run, ddl)
        out = part if out is None else out.unionByName(part)
    if (size.same or 1) > 1:
        same = normal.join(single.withColumnRenamed("item_id", "_one"), "words").select("_one", F.col("item_id").alias("_each"))
        out = out.join(same, F.col("item_id") == F.col("_one")).withColumn("item_id", F.col("_each")).drop("_one", "_each")
    return out


def _letter_offsets(text: str) -> tuple[str, list[int]]:
    """``letters`` of a text, and where each of them stands in it."""
    skip = [m.span() for m in _TAG.finditer(text)] + [m.span() for m in _ENTITY.finditer(text)]
    out, at, k = [], [], 0
    skip.sort()
    for n, c in enumerate(text):
        while k < len(skip) and n >= skip[k][1]:
            k += 1
        if k < len(skip) and skip[k][0] <= n:
            continue
        for x in letters(c):
            out.append(x), at.append(n)
    return "".join(out), at


def remove_leaks(documents: DataFrame, eval_items: DataFrame, drop: bool = False) -> DataFrame:
    """``documents`` without the leaked passages (their texts cut out), or with ``drop`` without the documents that hold any."""
    found = find_leaks(documents, eval_items, spans=True)
    if drop:
        return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    spans = found.groupBy("doc_id").agg(F.collect_set(F.struct("start_letter", "end_letter")).alias("_spans"))

    @F.pandas_udf("string")
    def cut_out(texts, spans):  # noqa: ANN001, ANN202
        out = []
        for text, cuts in zip(texts, spans):
            if text is not None and cuts is not None and len(cuts):
                _, at = _letter_offsets(text)
                for c in sorted(cuts, key=lambda c: -c["start_letter"]):
                    if c["end_letter"] <= len(at):
                        text = text[: at[c["start_letter"]]] + text[at[c["end_letter"] - 1] + 1 :]
            out.append(text)
        import pandas as pd

        return pd.Series(out, dtype=object)

    return documents.join(spans, "doc_id", "left").withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(cut_out("text", "_spans"))).drop("_spans")
