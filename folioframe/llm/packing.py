"""Filling fixed-capacity containers: conflict-constrained best-fit on token sizes.

Documents are hashed into groups of bounded size, and every (specification, group) is packed on its
own: items in order of decreasing size go to the open container whose free space is the smallest
that fits. Open containers are kept by free space; a bit set over the free spaces gives the
successor of a size, and the search moves on until the tightest *compatible* container is found.
Bitmaps over the containers say which have a duplicate cluster and which a source: a cluster that is
already in the container is a conflict, a source that is already there only loses a tie. All
containers of equal free space take part in a tie.

A cluster with more copies than the group's tokens fill containers could not be spread without
leaving them empty; its copies may then stand as often in one container as an even spread takes.
All copies of one size are placed in one sweep over the free spaces, so a cluster that holds a
third of all documents costs one sweep and not one search through all containers per copy.

An item larger than the capacity is cut into full pieces and a rest; no other item is split.
Defined results: null and empty texts have size 0 and go to the group's first container; ties go
to the container opened first; the result doesn't depend on the order of the rows; an empty table
gives no rows; a specification with a capacity below 1 gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.tokenise import count_column

#: Documents of a group.
GROUP_DOCUMENTS = 50_000

SCHEMA = "spec_id int, container_id bigint, doc_id bigint, piece_no int, n_tokens int"


class Containers:
    """Open containers ordered by free space."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.free: list[int] = []
        self.copies: dict[tuple[int, int], int] = {}
        # bitmaps of containers: by free space, by source, and those that have all they may have of a cluster
        self.at: dict[int, int] = {}
        self.sources: dict[int, int] = {}
        self.full: dict[int, int] = {}
        self.some = 0  # bit per free space that some container has

    def open(self) -> int:
        b = len(self.free)
        self.free.append(self.capacity)
        self._put(b, self.capacity)
        return b

    def _put(self, b: int, free: int) -> None:
        self.at[free] = self.at.get(free, 0) | 1 << b
        self.some |= 1 << free

    def successor(self, size: int) -> int | None:
        """The least free space of at least ``size`` that a container has."""
        m = self.some >> size
        return size + (m & -m).bit_length() - 1 if m else None

    def add(self, b: int, size: int, cluster: int | None, limit: int, source: int) -> None:
        old = self.free[b]
        self.at[old] ^= 1 << b
        if not self.at[old]:
            del self.at[old]
            self.some &= ~(1 << old)
        self.free[b] = old - size
        self._put(b, old - size)
        if cluster is not None:
            n = self.copies[b, cluster] = self.copies.get((b, cluster), 0) + 1
            if n >= limit:
                self.full[cluster] = self.full.get(cluster, 0) | 1 << b
        self.sources[source] = self.sources.get(source, 0) | 1 << b

    def fits(self, free: int, cluster: int | None) -> int:
        """All containers with that free space but those that have the cluster as often as it may stand there."""
        here = self.at.get(free, 0)
        return here if cluster is None else here & ~self.full.get(cluster, 0)

    def first(self, among: int, source: int) -> int:
        """The container opened first of those without the source, or of all if each has it."""
        m = among & ~self.sources.get(source, 0) or among
        return (m & -m).bit_length() - 1

    def place(self, size: int, cluster: int | None, limit: int, sources: list[int]) -> list[int]:
        """Containers of equal items, one per source in ``sources``; new ones are opened as needed."""
        out: list[int] = []
        while len(out) < len(sources):
            got = len(out)
            r = self.successor(size)
            while r is not None and len(out) < len(sources):
                m = self.fits(r, cluster)
                while m and len(out) < len(sources):
                    b = self.first(m, sources[len(out)])
                    self.add(b, size, cluster, limit, sources[len(out)])
                    out.append(b)
                    m = 0 if cluster is None else m ^ 1 << b  # what is left of the container may be the tightest for the next item
                r = self.successor(size) if cluster is None else self.successor(r + 1)
            if len(out) == got:  # no compatible container is left
                b = self.open()
                self.add(b, size, cluster, limit, sources[len(out)])
                out.append(b)
        return out


def pack(items: list[tuple[int, int, int, int]], capacity: int) -> list[tuple[int, int, int, int]]:
    """(container, doc, piece, size) of items (doc, size, cluster, source) in one group."""
    pieces: list[tuple[int, int, int, int, int]] = []
    for doc, size, cluster, source in items:
        k, rest = divmod(size, capacity)
        pieces += [(capacity, cluster, doc, i + 1, source) for i in range(k)]
        if rest or not k:
            pieces.append((rest, cluster, doc, k + 1, source))
    count: dict[int, int] = {}
    for size, cluster, _, _, _ in pieces:
        if 0 < size < capacity:
            count[cluster] = count.get(cluster, 0) + 1
    needed = max(1, math.ceil(sum(p[0] for p in pieces) / capacity))
    bit = {c: i for i, c in enumerate(sorted(c for c, n in count.items() if n > 1))}
    src = {s: i for i, s in enumerate(sorted({p[4] for p in pieces}))}
    pieces.sort(key=lambda p: (-p[0], p[1], p[2], p[3]))
    boxes, out, i = Containers(capacity), [], 0
    while i < len(pieces):
        size, cluster = pieces[i][:2]
        j = i
        while j < len(pieces) and pieces[j][:2] == (size, cluster):
            j += 1
        run = pieces[i:j]
        if size == 0:
            b = 0 if boxes.free else boxes.open()
            out += [(b, p[2], p[3], 0) for p in run]
        else:
            c = bit.get(cluster) if size < capacity else None
            limit = max(1, math.ceil(count.get(cluster, 1) / needed))
            where = boxes.place(size, c, limit, [src[p[4]] for p in run])
            out += [(b, p[2], p[3], size) for b, p in zip(where, run)]
        i = j
    return out


def sized(documents: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, size, cluster, source) of every document; clusters are texts equal but for case and white space, blank ones apart."""
    text = F.coalesce(F.lower(F.regexp_replace("text", r"\s+", " ")), F.lit(""))
    return documents.select(
        "doc_id", count_column("text", tokenizer).alias("size"), F.when(text.rlike(r"\S"), F.xxhash64(text)).otherwise(F.xxhash64("doc_id", F.lit("blank"))).alias("cluster"), F.xxhash64(F.coalesce("source", F.lit(""))).alias("source")
    )


def containers(documents: DataFrame, pack_spec: DataFrame, group: int = GROUP_DOCUMENTS) -> DataFrame:
    """Assignment of every document to a container of every specification.

    ``container_id`` is unique per specification. The specifications are a small fixed table.
    """
    specs = pack_spec.filter("capacity_tokens > 0").select("spec_id", "tokenizer", "capacity_tokens").collect()
    n_groups = max(1, math.ceil(documents.count() / group))
    out = None
    for tokenizer in sorted({s.tokenizer for s in specs}):
        own = [(s.spec_id, s.capacity_tokens) for s in specs if s.tokenizer == tokenizer]
        each = F.array(*(F.struct(F.lit(i).alias("spec_id"), F.lit(c).alias("capacity")) for i, c in own))
        # only sizes and hashes are shuffled; the texts stay where they are read
        items = sized(documents, tokenizer).withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(n_groups)).cast("int"))
        items = items.withColumn("spec", F.explode(each)).select("spec.spec_id", "spec.capacity", "grp", "doc_id", "size", "cluster", "source")

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            spec, capacity, grp = int(pdf["spec_id"].iloc[0]), int(pdf["capacity"].iloc[0]), int(pdf["grp"].iloc[0])
            rows = pack(list(zip(*(pdf[c].tolist() for c in ("doc_id", "size", "cluster", "source")))), capacity)
            b, doc, piece, size = (list(x) for x in zip(*rows))
            return pd.DataFrame({"spec_id": spec, "container_id": [(grp << 32) + x for x in b], "doc_id": doc, "piece_no": piece, "n_tokens": size})

        part = items.groupBy("spec_id", "grp").applyInPandas(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else documents.sparkSession.createDataFrame([], SCHEMA)


def fill(assigned: DataFrame, pack_spec: DataFrame) -> DataFrame:
    """(spec_id, containers, tokens, fill) of an assignment."""
    c = assigned.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("t")).groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"))
    return c.join(pack_spec.select("spec_id", "capacity_tokens"), "spec_id").select(
        "spec_id", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill")
    )
