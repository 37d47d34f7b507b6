"""Near duplicates by BagMinHash signatures, banding and exact multiset overlap.

A document is the multiset of its five-word shingles (lower case, blanks between words).
Texts that are equal in this form are one item from the start; the work below is on items.

* Signature: every shingle drives Poisson processes of points (time, height) over the
  dyadic height levels (0,1], (1,2], (2,4], ...; a shingle that occurs c times uses the
  points of height up to c. Each point falls on one register, a register keeps its earliest
  time. Two items agree on a register with the probability of their weighted Jaccard
  similarity. Points of a process come in order of time, so it ends at the first one later
  than every register.
* Bands of six registers make buckets. Pairs of small buckets are verified one by one. In
  the others items are compared by signature and join into groups: any two that share a
  bucket and look alike are in one group.
* Verification is on the multisets, within a group down to its classes. Links are joined
  into classes by label propagation.
* Large buckets and groups are taken apart in two rounds (:func:`linked_in`): blocks of bounded
  size, each with a few items of the whole; then only items outside the largest class so far
  against all. A look-alike group of n items costs n comparisons times the block's size, not
  n^2, and no pair that could join two classes is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.llm.exact_dedup import met as dealt
from barweave.llm.common import as_strings, fresh, id_key, lean, one_space, ragged, stored, text_or_empty, text_slices

WIDTH = 5
SIMILARITY = 0.8
REGISTERS = 256
BAND_ROWS = 6
BANDS = 42  # 252 of the registers; a pair at 0.8 meets in some band but for 3 in a million
FEW = 8  # buckets up to this size emit all their pairs
MANY = 1024  # larger buckets are dealt into blocks of about this size, every two of which meet
SLICE_BYTES = 4 << 20  # text whose points are drawn at once
LIKELY = 0.7  # estimate from which a pair is verified: 0.8 less four standard errors
BLOCK_BYTES = 8 << 20  # multisets of one block of a group
BLOCK = 128  # items of one block of a group
HEADS = 16  # items of a key, on average, that all its blocks see

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(z: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def unit(z: np.ndarray) -> np.ndarray:
    return (z >> np.uint64(11)).astype(np.float64) * 2.0**-53


def normal_form(text: Column | str = "text") -> Column:
    return F.trim(one_space(F.lower(text_or_empty(text))))


def shingles(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit shingle hashes (with repeats) of every text in normal form, and bounds.

    A text of fewer than ``width`` words is one shingle of all its words; one without
    words has none.
    """
    import xxhash

    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    bounds = np.zeros(len(texts) + 1, np.int64)
    if low == high:
        return np.empty(0, np.uint64), bounds
    rows = offsets.astype(np.int64) - low
    data = np.frombuffer(texts.buffers()[2], np.uint8)[low:high]
    cut = np.zeros(len(data) + 1, bool)
    cut[:-1] = data == 32
    cut[rows] = True
    starts = np.flatnonzero(cut[:-1])
    # The blank before a word stays with it; only the first word of a text has none.
    words = pa.StringArray.from_buffers(
        len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data)
    ).dictionary_encode()
    hashed = np.array([xxhash.xxh3_64_intdigest(w.strip(" ")) for w in words.dictionary.to_pylist()], np.uint64)
    w = mix(hashed)[words.indices.to_numpy()]
    first = np.searchsorted(starts, rows, side="left")
    n_words = np.diff(first)
    n = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    bounds[1:] = np.cumsum(n)
    out = np.zeros(bounds[-1], np.uint64)
    long = n_words >= width
    take = np.repeat(first[:-1][long] - (np.cumsum(n[long]) - n[long]), n[long]) + np.arange(n[long].sum())
    with np.errstate(over="ignore"):
        h = np.zeros(len(take), np.uint64)
        for k in range(width):
            h = mix(h * _GOLDEN + w[take + k])
        out[np.repeat(long, n)] = h
        for i in np.flatnonzero(~long & (n_words > 0)):
            short = np.uint64(n_words[i])
            for value in w[first[i] : first[i + 1]]:
                short = mix(np.array([short * _GOLDEN + value], np.uint64))[0]
            out[bounds[i]] = short
    for a, b in zip(bounds[:-1], bounds[1:]):
        out[a:b].sort()
    return out, bounds


def runs(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, how often they occur, and the text's number."""
    if not len(values):
        return values, np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.append(True, values[1:] != values[:-1])
    new[bounds[:-1][np.diff(bounds) > 0]] = True
    at = np.flatnonzero(new)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return values[at], np.diff(np.append(at, len(values))), text[at]


def bag_minhash(values: np.ndarray, counts: np.ndarray, text: np.ndarray, n_texts: int, m: int = REGISTERS) -> np.ndarray:
    """Earliest point times, (n_texts, m); infinite where a text has no shingle."""
    registers = np.full((n_texts, m), np.inf)
    seeds, owner, weight, low, width = [], [], [], [], []
    level, floor = 0, 0
    at = np.arange(len(values))
    with np.errstate(over="ignore"):
        while len(at):
            size = max(1, floor)
            seeds.append(mix(values[at] + np.uint64(level + 1) * _GOLDEN))
            owner.append(text[at])
            weight.append(counts[at].astype(np.float64))
            low.append(np.full(len(at), float(floor)))
            width.append(np.full(len(at), float(size)))
            level, floor = level + 1, floor + size
            at = at[counts[at] > floor]
        if not seeds:
            return registers
        state, owner, weight, low, width = map(np.concatenate, (seeds, owner, weight, low, width))
        time, latest, flat = np.zeros(len(state)), np.full(n_texts, np.inf), registers.reshape(-1)
        touched = np.zeros(n_texts, bool)
        while len(state):
            state = state + _GOLDEN
            draw = mix(state)
            time = time - np.log1p(-unit(draw)) / (m * width)
            alive = time <= latest[owner]
            if not alive.all():
                state, owner, weight, low, width, time, draw = (
                    x[alive] for x in (state, owner, weight, low, width, time, draw)
                )
            place = mix(draw ^ np.uint64(0xD1B54A32D192ED03))
            inside = low + width * unit(place) < weight
            register = (place & np.uint64(m - 1)).astype(np.int64)
            np.minimum.at(flat, (owner * m + register)[inside], time[inside])
            touched[:] = False
            touched[owner] = True
            some = np.flatnonzero(touched)
            latest[some] = registers[some].max(axis=1)
    return registers


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per band, the band's number mixed in."""
    bits = np.ascontiguousarray(registers).view(np.uint64)
    keys = np.empty((len(bits), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            h = np.full(len(bits), band + 1, np.uint64)
            for r in range(band * BAND_ROWS, (band + 1) * BAND_ROWS):
                h = mix(h * _GOLDEN + bits[:, r])
            keys[:, band] = h
    return keys.view(np.int64)


def short_registers(registers: np.ndarray) -> np.ndarray:
    """One byte per register, enough to estimate similarity."""
    return (mix(np.ascontiguousarray(registers).view(np.uint64)) >> np.uint64(56)).astype(np.uint8)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()  # one entry per distinct text of the task
    for batch in batches:
        refs = batch.column("ref").to_pylist()
        fresh = []
        for i, ref in enumerate(refs):
            if ref not in seen:
                seen.add(ref)
                fresh.append(i)
        batch = batch.take(pa.array(fresh, pa.int64()))
        texts = as_strings(batch.column("norm"))
        for a, b in text_slices(texts, SLICE_BYTES):
            values, bounds = shingles(texts.slice(a, b - a))
            registers = bag_minhash(*runs(values, bounds), b - a)
            some = np.flatnonzero(np.diff(bounds) > 0)
            keys, short = band_keys(registers[some]), short_registers(registers[some])
            yield pa.RecordBatch.from_pydict(
                {
                    "ref": batch.column("ref").slice(a, b - a).take(pa.array(some)),
                    "bands": pa.ListArray.from_arrays(
                        pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.reshape(-1))
                    ),
                    "short": pa.array([row.tobytes() for row in short], pa.binary()),
                }
            )


def similar(signatures: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Estimated similarity of each row to one signature, chance agreement removed."""
    return (np.count_nonzero(signatures == to, axis=1) / REGISTERS - 1 / 256) / (1 - 1 / 256)


def firsts(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """The first item of each item's connected class; ``near(i, rest)`` says which of the
    items ``rest`` are linked to ``i``. Items that have joined are not compared again."""
    first, rest = np.arange(n), np.arange(n)
    while len(rest):
        start, rest = rest[0], rest[1:]
        queue = [start]
        while queue and len(rest):
            found = near(queue.pop(), rest)
            if found.any():
                first[rest[found]] = start
                queue.extend(rest[found])
                rest = rest[~found]
    return first


def _bucket(likely: float) -> Callable[[pa.Table], pa.Table]:
    """Items that are not the first of their group, with that one."""

    def run(table: pa.Table) -> pa.Table:
        refs = table.column("ref").to_numpy()
        signatures = np.frombuffer(b"".join(table.column("short").to_pylist()), np.uint8).reshape(len(refs), REGISTERS)
        refs, order = np.unique(refs, return_index=True)
        signatures = signatures[order]
        first = firsts(len(refs), lambda i, rest: similar(signatures[rest], signatures[i]) >= likely)
        joined = first != np.arange(len(refs))
        return pa.table({"ref": pa.array(refs[joined]), "near": pa.array(refs[first[joined]])})

    return run


def met(rows: DataFrame, blocks: Column) -> DataFrame:
    """``rows`` dealt by ref into ``blocks``, with a task (low, high) for every two blocks: any
    two rows of a key share one. One or two blocks are one task."""
    dealt = rows.withColumn("_k", blocks.cast("int")).withColumn("_in", F.pmod(F.xxhash64("ref"), F.col("_k")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("_k") - 1), lambda j: (j != F.col("_in")) | (F.col("_k") == 1))
    return (
        dealt.withColumn("_with", F.explode(others))
        .withColumns({"low": F.least("_in", "_with"), "high": F.greatest("_in", "_with")})
        .drop("_k", "_in", "_with")
    )


def contracted(edges: DataFrame) -> DataFrame:
    """The same classes by fewer edges, for an item that joined others under many keys: it keeps
    the smallest, and that one takes the others, once for all items that have them."""
    low = edges.groupBy("ref").agg(F.min("near").alias("low"))
    others = edges.join(low, "ref").where("near != low").select(F.col("near").alias("ref"), F.col("low").alias("near"))
    return stored(low.select("ref", F.col("low").alias("near")).unionByName(others.distinct()), "contracted")


def linked_in(items: DataFrame, run: Callable[[pa.Table], pa.Table], payload: DataFrame) -> DataFrame:
    """(ref, near): edges that join the items of each key as all their links would.

    ``items`` (key, ref, n, k) are the members of keys of n items in k blocks, ``payload`` has
    by ref what ``run`` compares. ``run`` gets a table with the flags ``one`` and ``other``; it links
    items of the one kind with those of the other and gives joined items with the first of
    their class. First every block by itself, with some HEADS items of its key. If
    classes are left beside a key's largest, their items then meet all items of the key:
    two items that never met are in one class already.
    """
    total = F.col("k") - 1
    own = stored(
        items.select("key", "ref", "n", F.col("k").cast("int").alias("k")).withColumn(
            "block", F.pmod(F.xxhash64("ref"), F.col("k")).cast("int")
        ),
        "blocks",
    )
    head = F.pmod(F.xxhash64("ref", F.lit(1)), F.ceil(F.col("n") / HEADS)) == 0
    heads = own.where((F.col("k") > 1) & head).withColumn("at", F.explode(F.sequence(F.lit(0), total)))
    yes = F.lit(True)
    tasks = (
        own.withColumn("at", F.col("block"))
        .unionByName(heads.where(F.col("at") != F.col("block")))
        .select("key", F.lit(0).alias("part"), "at", "ref", yes.alias("one"), yes.alias("other"))
    )

    def compared(tasks: DataFrame) -> DataFrame:
        found = tasks.join(payload, "ref").groupBy("key", "part", "at").applyInArrow(run, "ref long, near long")
        return contracted(stored(found.distinct(), "joined"))

    edges = compared(tasks)
    large = own.where("k > 1")
    if large.isEmpty():
        return edges
    labels = components(edges.select(F.col("near").alias("a"), F.col("ref").alias("b")))
    labelled = stored(
        large.join(labels, F.col("ref") == F.col("node"), "left").select(
            *own.columns, F.coalesce("label", "ref").alias("label")
        ),
        "block-labels",
    )
    counts = labelled.groupBy("key", "label").agg(F.count("*").alias("m"), F.first("k").alias("k"))
    # One row per block of a key, so that a large key's items meet it in many places.
    main = (
        counts.groupBy("key")
        .agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("all"), F.first("k").alias("k"))
        .where(F.col("all") > F.col("top.m"))
        .select(
            "key",
            F.col("top.label").alias("main"),
            F.ceil((F.col("all") - F.col("top.m")) / BLOCK).cast("int").alias("parts"),
            F.explode(F.sequence(F.lit(0), total)).alias("block"),
        )
    )
    open_ = stored(labelled.join(main, ["key", "block"]), "open-blocks")
    if open_.isEmpty():
        return edges
    part = F.pmod(F.xxhash64("ref", F.lit(2)), F.col("parts")).cast("int")
    no = F.lit(False)
    rest = open_.where("label != main").select(
        "key", part.alias("part"), F.explode(F.sequence(F.lit(0), total)).alias("at"), "ref", yes.alias("one"), no.alias("other")
    )
    met_by = open_.select(
        "key",
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.col("block").alias("at"),
        "ref",
        no.alias("one"),
        yes.alias("other"),
    )
    return edges.unionByName(compared(rest.unionByName(met_by)))


def candidates(signatures: DataFrame, likely: float = LIKELY) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a < b) of items to verify, and groups (ref, label) all pairs of which are
    to be verified; no pair is in both."""
    rows = signatures.select("ref", F.explode("bands").alias("key"))
    sizes = stored(
        rows.groupBy("key")
        .agg(F.count("*").alias("n"), F.min("ref").alias("a"), F.max("ref").alias("b"))
        .where("n > 1"),
        "bucket-sizes",
    )
    twos = sizes.where("n = 2").select("a", "b")
    members = rows.join(sizes.where("n > 2").select("key", "n"), "key")
    x, y = F.col("x"), F.col("y")
    few = (
        members.where(F.col("n") <= FEW)
        .groupBy("key")
        .agg(F.sort_array(F.collect_list("ref")).alias("refs"))  # FEW at most
        .select("refs", F.explode("refs").alias("x"))
        .select("x", F.explode("refs").alias("y"))
        .where(x < y)
        .select(x.alias("a"), y.alias("b"))
    )
    full = members.where(F.col("n") > FEW).withColumn("k", F.ceil(F.col("n") / MANY))
    near = linked_in(full, _bucket(likely), signatures.select("ref", "short"))
    groups = components(near.select(F.col("near").alias("a"), F.col("ref").alias("b")))
    side = [groups.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")) for c in "ab"]
    pairs = (
        twos.unionByName(few)
        .distinct()
        .join(side[0], "a", "left")
        .join(side[1], "b", "left")
        .where("label_a IS NULL OR label_b IS NULL OR label_a != label_b")
        .select("a", "b")
    )
    return pairs, groups.select(F.col("node").alias("ref"), "label")


def _multisets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_strings(batch.column("norm"))
        for a, b in text_slices(texts, SLICE_BYTES):
            values, bounds = shingles(texts.slice(a, b - a))
            yield pa.RecordBatch.from_pydict(
                {
                    "ref": batch.column("ref").slice(a, b - a),
                    "bag": pa.array([values[x:y].tobytes() for x, y in zip(bounds, bounds[1:])], pa.binary()),
                }
            )


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted multisets."""
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    both = int(np.minimum(ca[i], cb[j]).sum())
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _verified(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [[np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(c)] for c in ("bag_a", "bag_b")]
            found = np.array([overlap(a, b) for a, b in zip(*bags)], np.float64)
            keep = pa.array(np.flatnonzero(found >= similarity))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").take(keep), batch.column("b").take(keep), pa.array(found).take(keep)],
                names=["a", "b", "similarity"],
            )

    return run


def shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of every sorted multiset of ``a`` with every one of ``b``."""
    sizes = np.array([len(x) for x in (*a, *b)], np.int64)
    values, owner = np.concatenate([*a, *b]), np.repeat(np.arange(len(sizes)), sizes)
    at, counts, _ = runs(values, np.append(0, np.cumsum(sizes)))
    # The k-th copy of a shingle is an element of its own, so multisets become sets.
    copy = ragged(np.zeros(len(at), np.int64), counts)
    element = np.unique(values, return_inverse=True)[1].astype(np.int64) * (int(counts.max()) + 1) + copy
    element = np.unique(element, return_inverse=True)[1]
    mine = owner < len(a)
    x, y, i, j = element[mine], element[~mine], owner[mine], owner[~mine] - len(a)
    n = int(element.max()) + 1
    in_a, in_b = np.bincount(x, minlength=n), np.bincount(y, minlength=n)
    # Elements that many have go by matrix products, the others by lists of who has them.
    common = in_a * in_b * 64 >= len(a) * len(b)
    out = np.zeros((len(a), len(b)))
    columns = np.cumsum(common) - 1
    for start in range(0, int(common.sum()), 2048):
        parts = []
        for e, row, rows in ((x, i, len(a)), (y, j, len(b))):
            some = common[e] & (columns[e] >= start) & (columns[e] < start + 2048)
            parts.append(np.zeros((rows, 2048), np.float32))
            parts[-1][row[some], columns[e[some]] - start] = 1
        out += parts[0] @ parts[1].T
    rare = ~common & (in_a > 0) & (in_b > 0)
    x, i = x[rare[x]], i[rare[x]]
    holders = j[np.argsort(y, kind="stable")]
    begin = np.cumsum(in_b) - in_b
    edges = np.searchsorted(i, np.arange(len(a) + 1))
    for row, (p, q) in enumerate(zip(edges[:-1], edges[1:])):
        if p < q:
            out[row] += np.bincount(holders[ragged(begin[x[p:q]], in_b[x[p:q]])], minlength=len(b))
    return out


def _linked(similarity: float) -> Callable[[pa.Table], pa.Table]:
    """Of two blocks of a group, or one with itself: each item's first one of its class here,
    and its number of links."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("ref")
        refs = table.column("ref").to_numpy()
        bags = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("bag")]
        sizes = np.array([len(x) for x in bags], np.float64)
        block = table.column("block").to_numpy()
        one, other = (np.flatnonzero(block == table.column(c)[0].as_py()) for c in ("low", "high"))
        links = np.zeros((len(refs), len(refs)), bool)
        if len(one) and len(other):
            both = shared([bags[i] for i in one], [bags[i] for i in other])
            found = both / (sizes[one][:, None] + sizes[other][None, :] - both) >= similarity
            links[np.ix_(one, other)] = found
            links[np.ix_(other, one)] = found.T
        np.fill_diagonal(links, False)
        first, n = firsts(len(refs), lambda i, rest: links[i, rest]), links.sum(axis=1)
        some = n > 0
        return pa.table(
            {"ref": pa.array(refs[some]), "first": pa.array(refs[first[some]]), "n": pa.array(n[some].astype(np.int64))}
        )

    return run


def _joined(similarity: float) -> Callable[[pa.Table], pa.Table]:
    """Items of a block that are not the first of their class in it, with that one."""

    def run(table: pa.Table) -> pa.Table:
        refs, at = np.unique(table.column("ref").to_numpy(), return_inverse=True)
        bags: list[np.ndarray] = [np.empty(0, np.uint64)] * len(refs)
        for i, x in zip(at, table.column("bag").combine_chunks()):
            bags[i] = np.frombuffer(x.as_buffer(), np.uint64)
        sizes = np.array([len(x) for x in bags], np.float64)
        one, other = (np.unique(at[table.column(c).to_numpy()]) for c in ("one", "other"))
        links = np.zeros((len(refs), len(refs)), bool)
        if len(one) and len(other):
            both = shared([bags[i] for i in one], [bags[i] for i in other])
            found = both / (sizes[one][:, None] + sizes[other][None, :] - both) >= similarity
            links[np.ix_(one, other)] = found
            links[np.ix_(other, one)] |= found.T
        first = firsts(len(refs), lambda i, rest: links[i, rest])
        joined = first != np.arange(len(refs))
        return pa.table({"ref": pa.array(refs[joined]), "near": pa.array(refs[first[joined]])})

    return run


def group_classes(groups: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """(ref, near): edges that join the groups' items into their classes."""
    items = groups.join(bags.select("ref", F.octet_length("bag").alias("bytes")), "ref")
    sizes = stored(
        items.groupBy("label").agg(
            F.count("*").alias("n"), F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("bytes") / BLOCK_BYTES)).alias("k")
        ),
        "group-sizes",
    )
    spread = dealt(groups.withColumn("row", F.col("ref")), sizes, groups.count(), "label", "n")
    return linked_in(spread.withColumnRenamed("label", "key"), _joined(similarity), bags)


def group_links(groups: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """(ref, first, n): the links of the groups' items, summed up per task of two blocks. All
    pairs of a group are compared, as their number is what is asked for."""
    items = groups.join(bags.select("ref", F.octet_length("bag").alias("bytes")), "ref")
    sizes = items.groupBy("label").agg(
        F.ceil(F.greatest(F.count("*") / MANY, F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("k")
    )
    dealt = groups.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("ref"), F.col("k")).cast("int"))
    tasks = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(
        "label", "ref", "block", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high")
    )
    return (
        tasks.join(bags, "ref")
        .groupBy("label", "low", "high")
        .applyInArrow(_linked(similarity), "ref long, first long, n long")
    )


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected class, by label propagation with
    pointer jumping. Every round is a table in the shared folder; none reaches the driver."""
    edges = stored(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges"
    )
    labels = stored(
        edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")),
        "labels",
    )
    while True:
        # Labels are always nodes: take the smallest of the neighbours, then its own label.
        seen = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(seen, F.col("node") == F.col("a")).select(
            "node", F.col("label").alias("was"), F.least("label", "near").alias("label")
        )
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        new = stored(
            lower.join(jump, "label").select("node", "was", F.least("label", "root").alias("label")), "labels"
        )
        if new.where("label != was").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def near_duplicates(
    docs: DataFrame, similarity: float = SIMILARITY, likely: float = LIKELY, count_links: bool = False
) -> DataFrame:
    """(doc_id, ref, class_ref): every row with its item and its class.

    ``likely`` is the estimate from which two items of a large bucket come into one group. At 0
    all items of a bucket do, so every pair that shares a band is verified on its multisets and
    no estimate decides anything; the cost is the square of the largest group.

    ``count_links`` adds ``links``, the number of verified links of the item to different texts,
    over all pairs of its group and of its buckets up to FEW; this costs the square of the
    largest group, classes alone do not. Null texts are empty; texts without words are one class of exact copies. Rows may repeat, null
    doc_ids are rows like others, columns beside doc_id and text are not read, and an empty
    table gives no rows. Items are told apart by a 64-bit hash of the text in normal form.
    """
    norm = normal_form()
    base = docs.select("doc_id", norm.alias("norm")).withColumn("ref", F.xxhash64("norm"))
    signatures = stored(
        base.select("ref", "norm")
        .where("norm != ''")
        .mapInArrow(lean(_signatures), "ref long, bands array<bigint>, short binary")
        .dropDuplicates(["ref"]),
        "signatures",
    )
    pairs, groups = candidates(signatures, likely)
    pairs = stored(pairs, "pairs")
    needed = pairs.select(F.col("a").alias("ref")).unionByName(pairs.select(F.col("b").alias("ref")))
    needed = needed.unionByName(groups.select("ref")).distinct()
    # One text per item: the smallest id that has it.
    owners = base.select("ref", "doc_id").groupBy("ref").agg(id_key(F.min("doc_id")).alias("key"))
    wanted = owners.join(needed, "ref", "left_semi")
    bags = stored(
        base.withColumn("key", id_key("doc_id"))
        .join(wanted, ["ref", "key"], "left_semi")
        .select("ref", "norm")
        .mapInArrow(lean(_multisets), "ref long, bag binary")
        .dropDuplicates(["ref"]),
        "bags",
    )
    links = stored(
        pairs.join(bags.select(F.col("ref").alias("a"), F.col("bag").alias("bag_a")), "a")
        .join(bags.select(F.col("ref").alias("b"), F.col("bag").alias("bag_b")), "b")
        .mapInArrow(lean(_verified(similarity)), "a long, b long, similarity double"),
        "links",
    )
    found = group_links(groups, bags, similarity) if count_links else group_classes(groups, bags, similarity)
    inner = stored(found.withColumnRenamed("first", "near"), "group-links")
    edges = links.select("a", "b").unionByName(
        inner.where("ref != near").select(F.col("near").alias("a"), F.col("ref").alias("b"))
    )
    classes = components(edges).select(F.col("node").alias("ref"), F.col("label").alias("class_ref"))
    known, extra = classes, []
    if count_links:
        one = F.lit(1).cast("long").alias("n")
        degree = (
            links.select(F.col("a").alias("ref"), one)
            .unionByName(links.select(F.col("b").alias("ref"), one))
            .unionByName(inner.select("ref", "n"))
            .groupBy("ref")
            .agg(F.sum("n").alias("links"))
        )
        known, extra = classes.join(degree, "ref"), [F.coalesce("links", F.lit(0)).alias("links")]
    # An item's rows may be many: they meet its class in many places.
    rows = stored(base.select("doc_id", "ref").withColumn("row", F.monotonically_increasing_id()), "item-rows")
    copies = rows.groupBy("ref").agg(F.count("*").alias("copies"))
    items = stored(copies.join(known, "ref", "left"), "items")
    return dealt(rows, items, rows.count(), "ref", "copies").select(
        "doc_id", "ref", F.coalesce("class_ref", "ref").alias("class_ref"), *extra
    )


def duplicate_classes(
    docs: DataFrame, similarity: float = SIMILARITY, likely: float = LIKELY, count_links: bool = False
) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), class_size per row of ``docs``; ``links``
    too where asked for."""
    rows = stored(near_duplicates(docs, similarity, likely, count_links), "near-duplicates")
    sizes = stored(rows.groupBy("class_ref").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "class-sizes")
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    columns = ["doc_id", "class_id", "class_size", *(["links"] if count_links else [])]
    return dealt(numbered, sizes, rows.count(), "class_ref", "class_size").select(*columns)


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, likely: float = LIKELY) -> DataFrame:
    """The rows of ``docs``, one of each class: that with the smallest doc_id (null last).

    All columns stay as they are, whatever they are called; rows are read as in
    :func:`near_duplicates`.
    """
    found = near_duplicates(docs, similarity, likely).select("doc_id", "class_ref", "ref")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "ref"))
    ref, key, row = fresh(docs, "ref", "key", "row")
    stays = (
        found.groupBy("class_ref")
        .agg(first.alias("o"))
        .select(F.col("o.ref").alias(ref), id_key("o.doc_id").alias(key))
    )
    keyed = docs.withColumns({ref: F.xxhash64(normal_form()), key: id_key("doc_id")})
    one = Window.partitionBy(ref, key).orderBy(ref)
    return (
        keyed.join(stays, [ref, key], "left_semi")
        .withColumn(row, F.row_number().over(one))
        .where(F.col(row) == 1)
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
