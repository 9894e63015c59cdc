"""Near-duplicate vectors by product quantisation.

Vectors are scaled to length 1 and put into the inverted list of their nearest coarse centroid; what remains is
coded in subspaces. A vector probes several lists: a table of distances to the code words gives its distance to each
listed code. A pair goes on only if that distance, less the coded vector's own known error, is within the bound, which
drops no near pair of a probed list. The exact cosine then decides.

Probes are as many nearest lists as asked for, or with exact=True every list that the triangle inequality doesn't rule out by its radius.
Vectors of different lengths are never compared; each length has an index of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsynth.llm.common import written
from tabsynth.llm.components import connected_components

SUBSPACES, WORDS = 8, 256
#: Vectors that the centroids and code words are fit on: those with the smallest hashes, four for each list, within these bounds.
FIT_ROWS, MOST_FIT_ROWS = 16_384, 65_536
#: Vectors of a list, about, as long as that doesn't take more lists than the fit bears (16 million vectors); lists probed.
LIST_ROWS, MOST_LISTS, PROBES = 1_000, 16_384, 10
#: Rows of a list that one task compares: this many as listed, this many as probing.
HOME_BLOCK, PROBE_BLOCK = 2_048, 4_096


def kmeans(x: np.ndarray, k: int, turns: int = 8, seed: int = 7) -> np.ndarray:
    rnd = np.random.default_rng(seed)
    k = min(k, len(x))
    centre = x[rnd.choice(len(x), k, replace=False)].copy()
    for _ in range(turns):
        near = nearest(x, centre)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=k)
        centre[n > 0] = total[n > 0] / n[n > 0, None]
    return centre


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0)


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + 4096], centre).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


@dataclass
class Index:
    coarse: np.ndarray
    words: list[np.ndarray]

    @classmethod
    def fit(cls, x: np.ndarray, lists: int) -> Index:
        coarse = kmeans(x, lists)
        rest = x - coarse[nearest(x, coarse)]
        return cls(coarse, [kmeans(part, WORDS) for part in np.array_split(rest, min(SUBSPACES, x.shape[1]), axis=1)])

    @classmethod
    def single(cls, dim: int) -> Index:
        """One list and no code words to speak of: for lengths that the sample doesn't have."""
        return cls(np.zeros((1, dim), np.float32), [np.zeros((1, len(p)), np.float32) for p in np.array_split(np.arange(dim), min(SUBSPACES, dim))])

    def encode(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and how far each code lies from its vector."""
        parts = np.array_split(rest, len(self.words), axis=1)
        codes = np.stack([nearest(p, w) for p, w in zip(parts, self.words, strict=True)], 1).astype(np.uint8)
        error = sum(((p - w[c]) ** 2).sum(1) for p, w, c in zip(parts, self.words, codes.T, strict=True))
        return codes, np.sqrt(error)

    def table_distances(self, rest: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distances of residuals (rows) to codes (columns), from one table for each residual."""
        out = np.zeros((len(rest), len(codes)), np.float32)
        for p, w, c in zip(np.array_split(rest, len(self.words), axis=1), self.words, codes.T, strict=True):
            out += distances(p, w).astype(np.float32)[:, c]
        return np.sqrt(out)


def unit(raw: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(-1, dim)
    # scaling by the largest first keeps squares finite
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def near_duplicates(vectors: DataFrame, least: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label", probes: int = PROBES, list_rows: int = LIST_ROWS, exact: bool = False) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row.

    Rows link if their labels are equal and not null and their cosine is at least `least`. Vectors that are null, empty, zero
    or hold null or non-finite components link with nothing; vectors of unequal length don't link with one another. exact: every link is
    found, else those of the lists probed. Equal vectors are one class while searching, so a large group of copies costs no more than one of them. Repeated rows are
    vectors of their own; a null vec_id never names a component while a linked row has an id. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    x = F.transform(vector, lambda v: v.cast("double"))
    good = F.col(label).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), x.alias("x"), F.coalesce(good, F.lit(False)).alias("good"))
    rows = rows.select("vec_id", "label", F.when(F.col("good"), F.col("x")).alias("x"), F.when(F.col("good"), F.xxhash64("x")).alias("h1"), F.when(F.col("good"), F.xxhash64(F.lit(1), "x", F.lit(2))).alias("h2"))
    found = rows.where("h1 is not null").groupBy("label", "h1", "h2").agg(F.first("x").alias("x"), F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    classes = written(found.withColumn("cid", F.monotonically_increasing_id()), "classes")
    members = rows.select("vec_id", "label", "h1", "h2")
    count = classes.count()
    if not count:
        return members.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    lists = min(MOST_LISTS, max(1, count // list_rows))
    sample: dict[int, list[bytes]] = {}
    for r in classes.orderBy("h1", "h2", "label").limit(min(MOST_FIT_ROWS, max(FIT_ROWS, 4 * lists))).select("x").toLocalIterator():
        sample.setdefault(len(r["x"]), []).append(np.array(r["x"], np.float64).tobytes())
    fit_rows = sum(map(len, sample.values()))
    shared = spark.sparkContext.broadcast({dim: Index.fit(unit(raw, dim).astype(np.float32), max(1, lists * len(raw) // fit_rows)) for dim, raw in sample.items()})
    bound = float(np.sqrt(2 - 2 * least)) + 1e-4

    def each_length(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame, np.ndarray, Index, np.ndarray]]:
        """Parts of one length: the rows, their unit vectors, the index, distances to its centroids."""
        for batch in batches:
            for dim, own in batch.groupby(batch["x"].map(len)):
                index = shared.value.get(dim) or Index.single(dim)
                for at in range(0, len(own), 2048):
                    part = own.iloc[at : at + 2048]
                    x = unit([np.asarray(v, np.float64).tobytes() for v in part["x"]], dim)
                    yield dim, part, x, index, np.sqrt(distances(x.astype(np.float32), index.coarse))

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for dim, _, _, _, d in each_length(batches):
            yield pd.DataFrame({"dim": dim, "list": d.argmin(1).astype(np.int32), "d": d.min(1).astype(np.float64)})

    radii = {}
    if exact:
        for r in classes.select("x").mapInPandas(homes, "dim int, list int, d double").groupBy("dim", "list").agg(F.max("d").alias("d")).collect():
            radii[r["dim"], r["list"]] = r["d"]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for dim, part, x, index, d in each_length(batches):
            order = np.argsort(d, 1, kind="stable")
            if exact:
                reach = bound + 1e-3 + np.array([radii.get((dim, k), -9.0) for k in range(d.shape[1])])
                probed = [o[(np.arange(len(o)) == 0) | (row[o] <= reach[o])] for o, row in zip(order, d, strict=True)]
            else:
                probed = list(order[:, : min(probes, d.shape[1])])
            probed = [p.astype(np.int32) for p in probed]
            codes, error = index.encode(x.astype(np.float32) - index.coarse[order[:, 0]])
            n = np.array([len(p) for p in probed])
            row = np.repeat(np.arange(len(part)), n)
            yield pd.DataFrame({
                "label": part["label"].to_numpy()[row], "dim": np.int32(dim), "list": np.concatenate(probed), "home": np.arange(len(row)) == np.repeat(np.cumsum(n) - n, n), "cid": part["cid"].to_numpy()[row],
                "copies": part["copies"].to_numpy()[row], "probed": [probed[i] for i in row], "v": [x[i].tobytes() for i in row], "code": [codes[i].tobytes() for i in row], "error": error.astype(np.float64)[row],
            })

    kind = classes.schema["label"].dataType.simpleString()
    placed = written(classes.select("label", "cid", "copies", "x").mapInPandas(place, f"label {kind}, dim int, list int, home boolean, cid long, copies long, probed array<int>, v binary, code binary, error double"), "lists")
    blocks = placed.groupBy("label", "dim", "list").agg(F.ceil(F.count_if("home") / HOME_BLOCK).cast("int").alias("hs"), F.ceil(F.count(F.lit(1)) / PROBE_BLOCK).cast("int").alias("qs"))
    sized = placed.join(blocks, ["label", "dim", "list"]).where("hs > 0")
    listed = sized.where("home").select("*", F.lit(True).alias("listed"), F.pmod(F.xxhash64("cid"), "hs").cast("int").alias("hb"), F.explode(F.expr("sequence(0, qs - 1)")).alias("qb"))
    probing = sized.select("*", F.lit(False).alias("listed"), F.explode(F.expr("sequence(0, hs - 1)")).alias("hb"), F.pmod(F.xxhash64(F.lit(3), "cid"), "qs").cast("int").alias("qb"))

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        dim, at = key[1], key[2]
        index = shared.value.get(dim) or Index.single(dim)
        h, q = rows[rows["listed"]], rows[~rows["listed"]]
        none = pd.DataFrame({"cid": [], "other": [], "n": []}).astype({"cid": "int64", "other": "int64", "n": "int64"})
        if h.empty or q.empty:
            return none
        hv, qv = unit(list(h["v"]), dim), unit(list(q["v"]), dim)
        codes = np.frombuffer(b"".join(h["code"]), np.uint8).reshape(len(h), -1)
        error = h["error"].to_numpy()
        hc, qc, q_home, q_list = h["cid"].to_numpy(), q["cid"].to_numpy(), q["home"].to_numpy(), np.array([p[0] for p in q["probed"]])
        met_at = {c: set(p) for c, p in zip(hc, h["probed"], strict=True)} if exact else np.stack(h["probed"].to_numpy())
        left, right = [], []
        for i in range(0, len(q), 256):
            d = index.table_distances(qv[i : i + 256].astype(np.float32) - index.coarse[at], codes)
            a, b = np.nonzero(d <= bound + error)
            a += i
            keep = (qv[a] * hv[b]).sum(1) >= least
            a, b = a[keep], b[keep]
            # of two listed rows the pair counts once; with a visitor whose own list the other probes too, at the lower list
            met = np.array([m in met_at[c] for c, m in zip(hc[b], q_list[a], strict=True)], bool) if exact else (met_at[b] == q_list[a][:, None]).any(1)
            keep = np.where(q_home[a], qc[a] < hc[b], ~met | (at < q_list[a]))
            left.append(a[keep])
            right.append(b[keep])
        a, b = np.concatenate(left), np.concatenate(right)
        if not len(a):
            return none
        ids, back = np.unique(np.concatenate([qc[a], hc[b]]), return_inverse=True)
        x, y = back[: len(a)], back[len(a) :]
        links = np.bincount(x, h["copies"].to_numpy()[b], len(ids)) + np.bincount(y, q["copies"].to_numpy()[a], len(ids))
        root = np.arange(len(ids))
        while True:  # least reachable row of this block: as many edges as rows, however many pairs
            new = root.copy()
            np.minimum.at(new, x, root[y])
            np.minimum.at(new, y, root[x])
            new = new[new]
            if (new == root).all():
                break
            root = new
        return pd.DataFrame({"cid": ids, "other": ids[root], "n": links.astype(np.int64)})

    fields = ["label", "dim", "list", "hb", "qb", "listed", "home", "cid", "copies", "probed", "v", "code", "error"]
    pairs = written(listed.select(*fields).unionByName(probing.select(*fields)).groupBy("label", "dim", "list", "hb", "qb").applyInPandas(compare, "cid long, other long, n long"), "links")
    links = pairs.groupBy("cid").agg(F.sum("n").alias("n"))
    parts = connected_components(pairs, "cid", "other").withColumnRenamed("node", "cid")
    known = classes.join(links, "cid", "left").join(parts, "cid", "left").select("label", "h1", "h2", "least_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component"))
    least_ids = known.groupBy("component").agg(F.min("least_id").alias("component_id"))
    known = known.join(least_ids, "component").select("label", "h1", "h2", "n_links", "component_id")
    out = members.join(known, ["label", "h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id").cast("long")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
