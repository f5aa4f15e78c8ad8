"""Records of evaluation splits that recur in training, exactly or almost, by text or image.

Evaluation texts are indexed in shards of similar length (fmindex), each with lists of short
pieces (routing). Training texts are brought in order of length, so that a batch meets few
shards, and the lists say which of them can match a text of a shard. Only those are searched:
they are cut by backward search into disjoint
pieces, each as short as is rare enough. One edit breaks at most one piece and moves the
others by one place, so of any n pieces a pair within d edits keeps n - d, moved by at most
d; pairs are counted by the pieces they keep. For the pairs that remain the evaluation text
is read back from the index, the pieces are extended to maximal matches, whose spans are
merged and counted per pair, and the edit distance decides.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteforge.llm.fmindex import FMIndex
from noteforge.llm.forms import content, fields
from noteforge.llm.routing import Cut, PieceLists
from noteforge.operators.references import trimmed
from noteforge.session import HOT_ROWS, cut, salted_join, ship

#: Most edits, as a share of the longer text.
SHARE = 0.1
#: Characters of one index shard.
SHARD_CHARS = 2_000_000
#: First limit on the occurrences of a piece; raised until there are enough pieces.
RAREST = 16
#: Occurrences from which pieces are too common to locate; such texts are compared directly.
COMMON = 1024
#: Pieces that a pair must keep, where a text has enough.
KEPT = 3
#: Places located at once.
PLACES = 16_384
#: Characters of a batch of training texts.
BATCH_CHARS = 4_000_000
#: Letters that are searched one after the other in texts that were routed.
LANE = 96
#: Pairs of one key from which a join is split, and pairs of one part.
PAIRS = 2_000_000


def comparable(text: str | None) -> list[str]:
    """The forms of a text that are compared: its content, and for a field list also that of its fields in one order."""
    found = fields(text)
    forms = [content(text)] if found is None else [content(text), "".join(sorted(n + v for n, v in found))]
    return [t for t in dict.fromkeys(forms) if t]


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance by bit vectors, in the band of `most` edits; most + 1 if larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    i = 0
    short = min(len(a), len(b))
    while i < short and a[i] == b[i]:
        i += 1
    j = 0
    while j < short - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if len(a) > len(b):
        a, b = b, a
    m = len(a)
    if not m:
        return len(b)
    peq: dict[str, int] = defaultdict(int)
    for k, c in enumerate(a):
        peq[c] |= 1 << k
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    for k, c in enumerate(b):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & mask), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score - (len(b) - 1 - k) > most:
            return most + 1
        ph, mh = ((ph << 1) | 1) & mask, (mh << 1) & mask
        pv, mv = mh | (~(xv | ph) & mask), ph & xv
    return score


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def matches(a: np.ndarray, b: np.ndarray, seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of a in maximal matches with b, merged; seeds are (place in a, place in b) of matching letters."""
    spans = []
    for diagonal in {y - x for x, y in seeds}:
        at = np.array(sorted(x for x, y in seeds if y - x == diagonal))
        low, high = max(0, -diagonal), min(len(a), len(b) - diagonal)
        parted = np.concatenate(([low - 1], low + np.flatnonzero(a[low:high] != b[low + diagonal : high + diagonal]), [high]))
        right = np.searchsorted(parted, at, "right")
        spans += zip((parted[right - 1] + 1).tolist(), parted[right].tolist())
    out: list[tuple[int, int]] = []
    for x, y in sorted(set(spans)):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def shared(a: np.ndarray, b: np.ndarray, most: int, letters: int = 8) -> list[tuple[int, int]]:
    """(place in a, place in b) of the disjoint pieces of a that b holds within so many edits and not over and over."""
    places: dict[bytes, list[int]] = defaultdict(list)
    text = b.astype(np.uint32).tobytes()
    for k in range(len(b) - letters + 1):
        places[text[4 * k : 4 * (k + letters)]].append(k)
    text, longer = a.astype(np.uint32).tobytes(), len(b) - len(a)
    found = []
    for k in range(0, len(a) - letters + 1, letters):
        there = places.get(text[4 * k : 4 * (k + letters)], ())
        if len(there) <= RAREST:
            found += [(k, p) for p in there if abs(p - k) + abs(longer - p + k) <= most]
    return found


def near_matches(index: FMIndex, texts: list[str], share: float = SHARE, among: np.ndarray | None = None, lane: int = 512) -> list[tuple[int, int, int, int, int]]:
    """(number of the text, number of the indexed text, edits, merged spans, letters in them) of all pairs within the share.

    among: the pairs that can be, in order, as number of the text x number of indexed texts + number of the indexed text;
    texts with too few rare pieces are then compared with those alone, at once.
    lane: letters that are searched one after the other; with few texts, short lanes keep the steps few.
    """
    coded = [_codes(t) for t in texts]
    size = np.array([len(c) for c in coded], np.int64)
    whole = max(1, len(index.sizes))
    # the longer of a pair has at most size / (1 - share) characters
    most = np.floor(share * size / (1 - share) + 1e-9).astype(np.int64)
    todo = np.flatnonzero(size > 0) if len(index.sizes) else np.empty(0, np.int64)
    rarest = RAREST
    xs, ys, seeds = [], [], []
    while len(todo) and rarest <= (COMMON if among is None else RAREST):
        own, begin, length, lo, hi = index.pieces([coded[i] for i in todo], rarest, lane)
        n = hi - lo
        order = np.lexsort((n, own))
        own, begin, lo, n = own[order], begin[order], lo[order], n[order]
        number = np.bincount(own, minlength=len(todo))
        ready = number > most[todo]
        used = np.minimum(number, most[todo] + KEPT)  # the rarest
        lost = np.bincount(own[n == 0], minlength=len(todo))
        rank = np.arange(len(own)) - np.searchsorted(own, np.arange(len(todo)))[own]
        use = (ready & (lost <= most[todo]))[own] & (rank < used[own]) & (n > 0)
        own, begin, lo, n = own[use], begin[use], lo[use], n[use]
        upto = np.cumsum(n)
        kept = [np.empty((3, 0), np.int64)]
        at = 0
        while at < len(n):  # so many places at once
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PLACES, "right")))
            m = n[at:to]
            rows = np.repeat(lo[at:to], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            text, offset = index.locate(rows)
            piece = np.repeat(np.arange(at, to), m)
            x = todo[own[piece]]
            edits = np.floor(share * np.maximum(size[x], index.sizes[text]) + 1e-9)
            near = (np.abs(offset - begin[piece]) <= edits) & (np.abs(size[x] - index.sizes[text]) <= edits)
            kept.append(np.stack([x[near] * whole + text[near], piece[near], offset[near]]))
            at = to
        pair, piece, offset = np.concatenate(kept, axis=1)
        if len(pair):
            order = np.lexsort((piece, pair))
            pair, piece, offset = pair[order], piece[order], offset[order]
            new = np.concatenate(([True], (pair[1:] != pair[:-1]) | (piece[1:] != piece[:-1])))  # a piece counts once a pair
            found, first, count = np.unique(pair, return_index=True, return_counts=True)
            held = np.add.reduceat(new.astype(np.int64), first)
            if among is not None:
                can = np.isin(found, among)
                found, first, count, held = found[can], first[can], count[can], held[can]
            x, y = found // whole, found % whole
            edits = np.floor(share * np.maximum(size[x], index.sizes[y]) + 1e-9).astype(np.int64)
            for k in np.flatnonzero(held >= used[np.searchsorted(todo, x)] - edits).tolist():
                xs.append(int(x[k]))
                ys.append(int(y[k]))
                at = slice(first[k], first[k] + count[k])
                seeds.append(list(zip(begin[piece[at]].tolist(), offset[at].tolist())))
        todo = todo[~ready]
        rarest *= 8
    for i in todo.tolist():  # texts of endless repetitions have no rare pieces: all of fitting length, or routed, are compared
        theirs = np.arange(len(index.sizes)) if among is None else among[slice(*np.searchsorted(among, (i * whole, (i + 1) * whole)))] - i * whole
        larger = np.maximum(size[i], index.sizes[theirs])
        for j in theirs[np.abs(size[i] - index.sizes[theirs]) <= np.floor(share * larger + 1e-9)].tolist():
            xs.append(i)
            ys.append(j)
            seeds.append([] if among is None else None)
    theirs = np.unique(np.array(ys, np.int64))
    read = dict(zip(theirs.tolist(), index.contents(theirs)))
    known: dict[int, str] = {}
    out = []
    for i, j, places in zip(xs, ys, seeds):
        if places is None:
            places = shared(coded[i], read[j], math.floor(share * max(size[i], index.sizes[j]) + 1e-9))
        spans = matches(coded[i], read[j], places)
        letters = sum(b - a for a, b in spans)
        edits = 0
        if spans != [(0, max(size[i], index.sizes[j]))] or len({a - b for a, b in places}) > 1:
            d = math.floor(share * max(size[i], index.sizes[j]) + 1e-9)
            if j not in known:
                known[j] = read[j].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
            edits = edit_distance(texts[i], known[j], d)
            if edits > d:
                continue
        out.append((i, j, edits, len(spans), letters))
    return out


def near_pairs(index: FMIndex, texts: list[str], share: float = SHARE) -> list[tuple[int, int, int]]:
    """(number of the text, number of the indexed text, edits) of all pairs within the share."""
    return [m[:3] for m in near_matches(index, texts, share)]


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, side, print, form, form_print, norm, size), a row per form of a text; side 1 is training, 0 evaluation.

    print stands for all forms of a text. Texts without content are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [], [])
            for i, side, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                forms = comparable(text)
                whole = _digest("\0".join(forms))
                for form, norm in enumerate(forms):
                    for out, value in zip(rows, (i, side, whole, form, _digest(norm), norm, len(norm))):
                        out.append(value)
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds)], names=["doc_id", "side", "print", "form", "form_print", "norm", "size"])

    return docs.select("doc_id", "side", "text").mapInArrow(run, "doc_id bigint, side int, print binary, form int, form_print binary, norm string, size bigint")


def _band(size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) / F.lit(math.log(1.05))).cast("int")


SHARD = "low bigint, high bigint, lists binary, blob binary, shard int"


def _shards(evaluation: DataFrame, shard_chars: int) -> DataFrame:
    """(low, high, lists, blob, shard): piece lists and index of each shard; shards hold distinct texts of similar length.

    The driver sees one row per length band (5 % steps, so a few hundred at most).
    """
    bands = sorted(evaluation.groupBy(_band(F.col("size")).alias("b")).agg(F.sum(F.col("size") + 1).alias("chars")).collect())
    base: dict[int, int] = {}
    parts: dict[int, int] = {}
    shard, room = -1, 0
    for b, chars in bands:
        if chars > room:
            shard, room = shard + 1, shard_chars
        base[b], parts[b] = shard, max(1, -(-chars // shard_chars))
        if parts[b] > 1:
            shard, room = shard + parts[b] - 1, 0
        else:
            room -= chars
    if not base:
        return evaluation.sparkSession.createDataFrame([], SHARD)
    table = F.broadcast(evaluation.sparkSession.createDataFrame([(b, base[b], parts[b]) for b in base], "b int, base int, parts int"))
    placed = evaluation.withColumn("b", _band(F.col("size"))).join(table, "b").select((F.col("base") + F.pmod(F.xxhash64("print"), F.col("parts"))).cast("int").alias("shard"), "print", "norm", "size")

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("size")
        coded = [_codes(t) for t in group.column("norm").to_pylist()]
        index = FMIndex(coded, np.frombuffer(b"".join(group.column("print").to_pylist()), np.uint8).reshape(len(coded), -1))
        row = (len(coded[0]), len(coded[-1]), PieceLists(coded).dump(), index.dump(), group.column("shard")[0].as_py())
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32())
        return pa.table([pa.array([v], t) for v, t in zip(row, kinds)], names=["low", "high", "lists", "blob", "shard"])

    return placed.groupBy("shard").applyInArrow(build, SHARD)


def _read_shard(uri: str, column: str) -> bytes:
    """A column of a shard, which has a file of its own."""
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as f:
        return pq.ParquetFile(f).read([column]).column(column)[0].as_py()


def text_overlaps(docs: DataFrame, share: float = SHARE, shard_chars: int = SHARD_CHARS) -> tuple[DataFrame, DataFrame]:
    """(links, members) of (doc_id, side, text).

    links: (train_print, eval_print, edits, spans, letters) between distinct texts of which a form
    is equal or differs in at most `share` of the longer one's characters, with the least edits
    and the merged spans of their maximal matches; members:
    (doc_id, side, print). Each distinct form is searched once, however many copies it has.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = cut(_texts(docs), "texts")
    members = texts.where("form = 0").select("doc_id", "side", "print")
    held = texts.where("side = 0")
    firsts = held.groupBy("form_print").agg(F.min("doc_id").alias("doc_id"))
    distinct = held.join(firsts, ["form_print", "doc_id"], "left_semi").select(F.col("form_print").alias("print"), "norm", "size")
    shards = cut(_shards(distinct, shard_chars), "shards", ["shard"])
    where = sorted((r["low"], r["high"], r["f"]) for r in shards.select("low", "high", F.input_file_name().alias("f")).collect())
    # copies come one after the other and are passed over; of those with very many, all but one are left out before
    train = texts.where("side = 1")
    hot = F.broadcast(train.groupBy("form_print").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where(F.col("n") > HOT_ROWS).select("form_print", "first"))
    train = train.join(hot, "form_print", "left").where("first IS NULL OR first = doc_id").select(F.col("form_print").alias("print"), "norm", "size")
    train = train.repartitionByRange(F.col("size").desc(), "print").sortWithinPartitions(F.col("size").desc(), "print")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(prints: list, norms: list) -> pa.RecordBatch:
            rows: tuple[list, ...] = ([], [], [], [], [])
            pieces = Cut([_codes(t) for t in norms])
            for low, high, uri in where:
                first, last = np.searchsorted(pieces.size, low * (1 - share) - 1), np.searchsorted(pieces.size, high / (1 - share) + 1, "right")
                if first == last:
                    continue
                x, y = PieceLists.load(_read_shard(uri, "lists")).pairs(pieces, first, last, share)
                if not len(x):
                    continue
                index = FMIndex.load(_read_shard(uri, "blob"))
                at, number = np.unique(x, return_inverse=True)
                for i, j, *counts in near_matches(index, [norms[k] for k in at], share, np.sort(number * len(index.sizes) + y), LANE):
                    for out, value in zip(rows, (prints[at[i]], index.ids[j].tobytes(), *counts)):
                        out.append(value)
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds)], names=["train_form", "eval_form", "edits", "spans", "letters"])

        prints, norms, chars, last = [], [], 0, None
        for batch in batches:
            for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if p == last:
                    continue
                last = p
                prints.append(p)
                norms.append(t)
                chars += len(t)
                if chars >= min(shard_chars, BATCH_CHARS):
                    yield flush(prints[::-1], norms[::-1])
                    prints, norms, chars = [], [], 0
        if prints:
            yield flush(prints[::-1], norms[::-1])

    found = cut(train.select("print", "norm").mapInArrow(search, "train_form binary, eval_form binary, edits bigint, spans bigint, letters bigint"), "forms")
    forms = texts.groupBy("side", "print", "form_print").agg(F.min("doc_id").alias("doc_id"))
    train = forms.where("side = 1").select(F.col("form_print").alias("train_form"), F.col("print").alias("train_print"), F.col("doc_id").alias("train_id"))
    held = forms.where("side = 0").select(F.col("form_print").alias("eval_form"), F.col("print").alias("eval_print"), F.col("doc_id").alias("eval_id"))
    links = found.join(train, "train_form").join(held, "eval_form")  # few distinct texts share a form
    return cut(links.groupBy("train_print", "eval_print").agg(F.min("edits").alias("edits"), F.min_by("spans", "edits").alias("spans"), F.max("letters").alias("letters")), "links"), members


def shared_key_pairs(train: DataFrame, held: DataFrame, key: str, id_col: str = "doc_id", pairs: int = PAIRS) -> DataFrame:
    """(train_id, eval_id) of all rows with the same key. A key with many pairs is split.

    Keys with more than `pairs` pairs have over 2 sqrt(pairs) rows, which bounds the list of them.
    """
    n = train.groupBy(key).agg(F.count("*").alias("nt")).join(held.groupBy(key).agg(F.count("*").alias("ne")), key)
    big = F.broadcast(n.where(F.col("nt") * F.col("ne") > pairs).select(key, F.least(F.col("nt"), F.ceil(F.col("nt") * F.col("ne") / pairs)).cast("int").alias("parts")))
    one = F.lit(1)
    left = train.join(big, key, "left").select(key, F.col(id_col).alias("train_id"), F.pmod(F.xxhash64(id_col), F.coalesce("parts", one)).cast("int").alias("part"))
    right = held.join(big, key, "left").select(key, F.col(id_col).alias("eval_id"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", one) - 1)).alias("part"))
    return left.join(right, [key, "part"]).select("train_id", "eval_id")


def cross_split_pairs(docs: DataFrame, share: float = SHARE, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: one in train, the other in valid or test, alike in text or cover image.

    Texts count as in p5 and may differ in `share` of the longer one; image paths are trimmed,
    blank or null ones match nothing. Null and empty texts match nothing, texts of any length
    are searched whole, rows of other or null splits take no part, extra columns are ignored.
    Every pair is given once.
    """
    docs = docs.select("doc_id", F.when(F.col("split") == "train", 1).when(F.col("split").isin("valid", "test"), 0).alias("side"), "text", trimmed(F.col("image_path")).alias("path")).where("side IS NOT NULL")
    with_path = docs.where("path IS NOT NULL").select("doc_id", "side", "path")
    by_image = shared_key_pairs(with_path.where("side = 1"), with_path.where("side = 0"), "path")
    links, members = text_overlaps(docs, share, shard_chars)
    members = members.join(docs.select("doc_id", "path"), "doc_id")
    train = members.where("side = 1").select(F.col("print").alias("train_print"), F.col("doc_id").alias("train_id"), F.col("path").alias("train_path"))
    held = members.where("side = 0").select(F.col("print").alias("eval_print"), F.col("doc_id").alias("eval_id"), F.col("path").alias("eval_path"))
    by_text = salted_join(train, links.select("train_print", "eval_print"), ["train_print"], "train_id")
    by_text = salted_join(held, by_text, ["eval_print"], "eval_id").where("train_path IS NULL OR eval_path IS NULL OR train_path <> eval_path")
    both = by_image.unionByName(by_text.select("train_id", "eval_id"))
    return both.select(F.least("train_id", "eval_id").alias("doc_id_a"), F.greatest("train_id", "eval_id").alias("doc_id_b"))


def overlap_report(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """(split, source, n_docs, n_text, n_image, n_any) per evaluation split and source: how many recur in train."""
    docs = docs.select("doc_id", "split", "source", F.when(F.col("split") == "train", 1).when(F.col("split").isin("valid", "test"), 0).alias("side"), "text", trimmed(F.col("image_path")).alias("path")).where("side IS NOT NULL")
    links, members = text_overlaps(docs, share)
    hit_prints = links.select(F.col("eval_print").alias("print")).distinct()
    by_text = salted_join(members.where("side = 0"), hit_prints, ["print"], "doc_id").select("doc_id", F.lit(1).alias("t"))
    paths = docs.where("side = 1 AND path IS NOT NULL").select("path").distinct().withColumn("i", F.lit(1))
    held = docs.where("side = 0").select("doc_id", "split", "source", "path")
    found = held.join(by_text, "doc_id", "left").join(paths, "path", "left")
    return found.groupBy("split", "source").agg(
        F.count("*").alias("n_docs"), F.count("t").alias("n_text"), F.count("i").alias("n_image"), F.sum(F.when(F.col("t").isNotNull() | F.col("i").isNotNull(), 1).otherwise(0)).alias("n_any")
    )
