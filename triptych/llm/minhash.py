"""Near duplicates by MinHash: universal hash minima, banding, verification on full sets, components.

Texts with equal shingle sets form a class, so that copies meet once. Signatures of classes are cut
into bands; classes that share a band are candidates. The first round compares each class with one
hub, the class of its bands that shares bands with most others; this joins large groups without
making their pairs. The second looks at the bands whose classes are still in several components:
signatures are compared across these components in blocks, and what agrees is put in clusters, in
which full sets are compared in blocks. Rows stay as many as there are classes: pairs live only
inside a block. Every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triptych.llm.components import components
from triptych.llm.hashing import U64, chunks, mix, shingle_sets, text_buffer
from triptych.llm.text import whole
from triptych.staging import drop_staged, staged

WORDS = 5
# Percent of the union that the intersection must have.
SIMILARITY = 75
# A pair at 0.75 shares no band with probability (1 - 0.75 ** 4) ** 32 = 5.3e-6.
BANDS = 32
BAND_ROWS = 4
MINIMA = BANDS * BAND_ROWS
# Signatures that agree in fewer places are not compared on full sets: at 0.75, less is over 5
# standard deviations away.
LEAST_AGREEMENT = 0.55
# Classes of a block: those outside the largest component, and those they are compared with.
PROBES = 256
OTHERS = 1024

_SEED = np.random.default_rng(75)
MULTIPLY = _SEED.integers(0, 1 << 64, MINIMA, dtype=U64) | U64(1)
ADD = _SEED.integers(0, 1 << 64, MINIMA, dtype=U64)

SIGNED = "doc_id bigint, version bigint, n_shingles bigint, class binary, bands binary, brief binary"
LINK = "u bigint, v bigint"


def minhash_dedup(documents: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A shingle is five words, words being lower-cased in A-Z; a text of fewer words is one shingle.
    Documents are linked when the intersection of their sets has at least `percent` of the union;
    component_id is the smallest doc_id reachable.

    A null text, or one without words, has no shingles and links with nothing; so does a row with a
    null doc_id, whose component_id is null and which is kept. Rows that repeat a doc_id are one
    document to the components: a link of either text is a link of the doc_id. Other columns are
    not read. An empty table gives an empty result.
    """
    signed = staged(signatures(documents).withColumn("row", F.monotonically_increasing_id()), "minhash-signed")
    members = signed.where("doc_id is not null and n_shingles > 0")
    # A class is named by a row that holds it.
    first = members.groupBy("class").agg(F.min(F.struct("doc_id", "row", "version")).alias("first"))
    classes = staged(
        first.select("class", F.col("first.row").alias("id"), F.col("first.doc_id").alias("node"), "first.version"),
        "minhash-classes",
    )
    shared = _shared_bands(members, classes)
    sets = _full_sets(documents, classes, shared)
    linked = _linked_to_hubs(shared, sets, percent).unionByName(_repeated_ids(members, classes))
    tied = staged(components(linked), "minhash-components")
    clusters = _clusters(shared, tied, sets)
    star = tied.select(F.col("node").alias("u"), F.col("component").alias("v"))
    final = staged(components(star.unionByName(_linked_in_clusters(clusters, tied, sets, percent))), "minhash-components")
    placed = classes.join(final.withColumnRenamed("node", "id"), "id", "left").select(
        "class", "node", F.coalesce("component", "id").alias("component")
    )
    smallest = placed.groupBy("component").agg(F.min("node").alias("component_id"))
    named = staged(placed.join(smallest, "component").select("class", "component_id"), "minhash-named")
    drop_staged(shared, sets)
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return (
        signed.select("doc_id", "n_shingles", "class")
        .join(named, "class", "left")
        .select("doc_id", "n_shingles", own.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(whole("text")).alias("version"), whole("text").alias("text")
    )


def signatures(documents: DataFrame) -> DataFrame:
    """doc_id, version (a hash of the text), n_shingles, class (digest of the set), bands, brief.

    `bands` has a 64-bit hash of each band, `brief` the low byte of each minimum.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, after, sets, begin in _sets(batch.column("text")):
                filled = np.diff(begin) > 0
                bands, brief = _signature(sets, begin[:-1][filled])
                made = np.cumsum(filled) - 1
                digests = [xxhash.xxh3_128_digest(sets[s:e]) if e > s else None for s, e in zip(begin, begin[1:])]
                rows = lambda values: pa.array([values[k].tobytes() if f else None for k, f in zip(made, filled)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(first, after - first) for c in ("doc_id", "version")]
                    + [pa.array(np.diff(begin), pa.int64()), pa.array(digests, pa.binary()), rows(bands), rows(brief)],
                    ["doc_id", "version", "n_shingles", "class", "bands", "brief"],
                )

    return _texts(documents).mapInArrow(sign, SIGNED)


def _sets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_buffer(texts)
    for first, after in chunks(offsets):
        starts = offsets[first : after + 1] - offsets[first]
        yield first, after, *shingle_sets(data[offsets[first] : offsets[after]], starts, WORDS)


def _signature(sets: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every text the minima of the universal hashes x -> a x + b mod 2^64, as bands and low bytes."""
    bands = np.zeros((len(begin), BANDS), dtype=U64)
    brief = np.zeros((len(begin), MINIMA), dtype=np.uint8)
    if len(begin):
        hashed = np.empty_like(sets)
        for i in range(MINIMA):
            np.multiply(sets, MULTIPLY[i], out=hashed)
            np.add(hashed, ADD[i], out=hashed)
            least = mix(np.minimum.reduceat(hashed, begin))
            brief[:, i] = least
            bands[:, i // BAND_ROWS] = mix(bands[:, i // BAND_ROWS] + least + U64(i))
    return bands, brief


def _shared_bands(members: DataFrame, classes: DataFrame) -> DataFrame:
    """band, id, mass of the classes in each band that several have; `mass` counts whom a class meets."""
    own = members.join(classes.select("id").hint("merge"), F.col("row") == F.col("id"), "left_semi")
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("bands", i * 8 + 1, F.lit(8))))
    bands = own.select(F.explode(band).alias("band"), F.col("row").alias("id"))
    several = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = staged(bands.join(several.hint("merge"), "band"), "minhash-met")
    mass = shared.groupBy("id").agg(F.sum("n").alias("mass"))
    weighted = staged(shared.select("band", "id").join(mass, "id"), "minhash-shared")
    drop_staged(shared)
    return weighted


def _full_sets(documents: DataFrame, classes: DataFrame, shared: DataFrame) -> DataFrame:
    """id, shingles, brief of every class that shares a band."""
    needed = classes.join(shared.select("id").distinct(), "id", "left_semi").select(
        F.col("node").alias("doc_id"), "version", "id"
    )
    texts = _texts(documents).join(needed.hint("merge"), ["doc_id", "version"]).dropDuplicates(["doc_id", "version", "id"])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, after, sets, begin in _sets(batch.column("text")):
                _, brief = _signature(sets, begin[:-1])
                each = [sets[s:e].tobytes() for s, e in zip(begin, begin[1:])]
                columns = [batch.column("id").slice(first, after - first), pa.array(each, pa.binary())]
                columns.append(pa.array([b.tobytes() for b in brief], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["id", "shingles", "brief"])

    return staged(texts.select("id", "text").mapInArrow(compute, "id bigint, shingles binary, brief binary"), "minhash-sets")


def _linked_to_hubs(shared: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of classes to the hub that they share most bands with."""
    hubs = shared.groupBy("band").agg(F.max(F.struct("mass", "id")).alias("hub")).select("band", F.col("hub.id").alias("hub"))
    common = shared.join(hubs, "band").where("id != hub").groupBy("id", "hub").agg(F.count("*").alias("n"))
    pairs = staged(
        common.groupBy("id").agg(F.max(F.struct("n", "hub")).alias("best")).select("id", F.col("best.hub").alias("hub")),
        "minhash-pairs",
    )
    blocks = staged(pairs.groupBy("hub").agg(F.ceil(F.count("*") / OTHERS).cast("int").alias("blocks")), "minhash-hubs")
    dealt = pairs.join(blocks, "hub").select("id", "hub", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    ruled = blocks.select(F.col("hub").alias("id"), "hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    rows = dealt.withColumn("rank", F.lit(1)).unionByName(ruled.withColumn("rank", F.lit(0)))
    keys = ["hub", "block", "rank"]
    held = rows.join(sets, "id").repartition("hub", "block").sortWithinPartitions(*keys)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = shingles = brief = None
        for batch in batches:
            u, v = [], []
            columns = (batch.column(c).to_pylist() for c in ("hub", "rank", "id", "shingles", "brief"))
            for mine, rank, id_, own_set, own_brief in zip(*columns):
                own_set, own_brief = np.frombuffer(own_set, dtype=U64), np.frombuffer(own_brief, dtype=np.uint8)
                if rank == 0:
                    hub, shingles, brief = id_, own_set, own_brief
                elif np.count_nonzero(own_brief == brief) >= LEAST_AGREEMENT * MINIMA:
                    both = _common(own_set, shingles)
                    if 100 * both >= percent * (len(own_set) + len(shingles) - both):
                        u.append(id_)
                        v.append(hub)
            yield _links(u, v)

    return held.select(*keys, "id", "shingles", "brief").mapInArrow(verify, LINK)


def _links(u: list, v: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _probes(rows: DataFrame, group: str) -> DataFrame:
    """Rows (group, id, component) of groups with several components, dealt into blocks for comparison.

    The members outside the largest component are the probes; each probe meets all members, itself
    among them, in some block (group, p, o).
    """
    held = rows.groupBy(group, "component").agg(F.count("*").alias("n"))
    mixed = staged(
        held.groupBy(group)
        .agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("parts"))
        .where("parts > 1")
        .select(
            group,
            F.col("top.component").alias("top"),
            F.ceil((F.col("n") - F.col("top.n")) / PROBES).cast("int").alias("ps"),
            F.ceil(F.col("n") / OTHERS).cast("int").alias("os"),
        ),
        "minhash-mixed",
    )
    met = rows.join(mixed, group)
    every = lambda count: F.sequence(F.lit(0), F.col(count) - 1)
    mine = lambda count: F.pmod(F.xxhash64("id"), F.col(count)).cast("int")
    columns = [F.col(group).alias("block_group"), "id", "component"]
    probes = met.where(F.col("component") != F.col("top")).select(
        *columns, F.lit(True).alias("probe"), mine("ps").alias("p"), F.explode(every("os")).alias("o")
    )
    others = met.select(*columns, F.lit(False).alias("probe"), F.explode(every("ps")).alias("p"), mine("os").alias("o"))
    return probes.unionByName(others)


def _clusters(shared: DataFrame, tied: DataFrame, sets: DataFrame) -> DataFrame:
    """id, cluster: classes of one band whose signatures agree across components are in one cluster."""
    component = F.coalesce("component", "id").alias("component")
    rows = staged(
        shared.select("band", "id").join(tied.withColumnRenamed("node", "id"), "id", "left").select("band", "id", component),
        "minhash-placed",
    )
    blocks = _in_blocks(_probes(rows, "band").join(sets.select("id", F.col("brief").alias("value")), "id"))
    star = components(blocks.mapInArrow(_by_block(_agreeing), LINK))
    roots = star.select(F.col("component").alias("id"), F.col("component").alias("cluster")).distinct()
    return staged(star.select(F.col("node").alias("id"), F.col("component").alias("cluster")).unionByName(roots), "minhash-clusters")


def _linked_in_clusters(clusters: DataFrame, tied: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    component = F.coalesce("component", "id").alias("component")
    rows = clusters.join(tied.withColumnRenamed("node", "id"), "id", "left").select("cluster", "id", component)
    blocks = _in_blocks(_probes(rows, "cluster").join(sets.select("id", F.col("shingles").alias("value")), "id"))
    return blocks.mapInArrow(_by_block(lambda *block: _similar(*block, percent)), LINK)


def _in_blocks(rows: DataFrame) -> DataFrame:
    keys = ["block_group", "p", "o"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "probe", "id", "component", "value")


Block = Callable[[np.ndarray, np.ndarray, np.ndarray, list[bytes]], tuple[list, list]]


def _by_block(compare: Block) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links that `compare` finds in each block; rows of a block follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            keys = [table.column(i).to_numpy() for i in range(3)]
            change = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
            cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
            rest = table.slice(cuts[-1])
            yield from compared(table, cuts)
        if rest is not None:
            yield from compared(rest, [0, rest.num_rows])

    def compared(table: pa.Table, cuts: list[int]) -> Iterator[pa.RecordBatch]:
        u, v = [], []
        for first, after in zip(cuts, cuts[1:]):
            part = table.slice(first, after - first)
            found = compare(*(part.column(c).to_numpy() for c in ("probe", "id", "component")), part.column("value").to_pylist())
            u.extend(found[0])
            v.extend(found[1])
        yield _links(u, v)

    return run


def _agreeing(probe: np.ndarray, ids: np.ndarray, component: np.ndarray, values: list[bytes]) -> tuple[list, list]:
    """A star for each set of classes whose signatures agree across components."""
    brief = np.frombuffer(b"".join(values), dtype=np.uint8).reshape(len(ids), -1)
    root = np.arange(len(ids))
    others = np.flatnonzero(~probe)
    for i in np.flatnonzero(probe):
        near = others[component[others] != component[i]]
        near = near[(brief[near] == brief[i]).sum(axis=1) >= LEAST_AGREEMENT * MINIMA]
        if len(near):
            tied = np.unique(np.append(root[near], root[i]))
            root[np.isin(root, tied)] = tied[0]
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[moved].tolist(), ids[root[moved]].tolist()


def _similar(probe: np.ndarray, ids: np.ndarray, component: np.ndarray, values: list[bytes], percent: int) -> tuple[list, list]:
    """Of each probe one link to each other component that has a similar set."""
    others = np.flatnonzero(~probe)
    sets = [np.frombuffer(v, dtype=U64) for v in values]
    size = np.array([len(s) for s in sets])
    begin = np.concatenate([[0], np.cumsum(size[others])[:-1]]) if len(others) else np.zeros(0, dtype=np.int64)
    known, place = np.unique(np.concatenate([sets[k] for k in others]), return_inverse=True) if len(others) else (None, None)
    u, v = [], []
    for i in np.flatnonzero(probe):
        if not len(others):
            break
        held = np.zeros(len(known), dtype=bool)
        at = np.minimum(np.searchsorted(known, sets[i]), len(known) - 1)
        held[at[known[at] == sets[i]]] = True
        common = np.add.reduceat(held[place], begin, dtype=np.int64)
        similar = 100 * common >= percent * (size[others] + size[i] - common)
        near = others[similar & (component[others] != component[i])]
        near = near[np.unique(component[near], return_index=True)[1]]
        u.extend([int(ids[i])] * len(near))
        v.extend(ids[near].tolist())
    return u, v


def _common(p: np.ndarray, q: np.ndarray) -> int:
    """Elements in both of two ascending arrays without repeats."""
    if len(p) > len(q):
        p, q = q, p
    if not len(p):
        return 0
    at = np.searchsorted(q, p)
    return int(np.count_nonzero(q[np.minimum(at, len(q) - 1)] == p))


def _repeated_ids(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Links of classes that hold texts of one and the same doc_id."""
    several = (
        members.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a != b").select("doc_id")
    )
    held = members.select("doc_id", "class").join(several, "doc_id").join(classes.select("class", "id"), "class")
    least = held.groupBy("doc_id").agg(F.min("id").alias("v"))
    return held.join(least, "doc_id").select(F.col("id").alias("u"), "v").where("u != v")
