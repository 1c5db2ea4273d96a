"""Index specifications: parse a string, build and search the index it names.

    spec      = [transform ","]* body ["," refine]
    transform = "PCA" ["W"] ["R"] N | "L2norm" | "RR" [N] | "ITQ" [N] | "OPQ" M ["_" N] | "Pad" N
    body      = ["IDMap" ","] (basic | coarse "," code) | basic "," "IDMap"
    coarse    = "IVF" n ["_HNSW" [M] | "_NSG" r | "(" spec ")"] | "IMI" "2x" b | "Residual" ...
    refine    = "RFlat" | "Refine(" spec ")"

The parser gives a frozen tree; ``build`` fits what has to be fitted and returns an
``Index``, whose parts are tables and small matrices.
"""

from __future__ import annotations

import copy
import re
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codecs, graph, ivf, knn, refine, transforms
from .cluster import centroid_table

#: Bits of each half of a multi-index whose product of centroids is still made.
MOST_IMI_BITS = 8


class SpecError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    kind: str
    args: tuple = ()
    text: str = ""


@dataclass(frozen=True)
class Spec:
    text: str
    transforms: tuple[Node, ...] = ()
    coarse: Node | None = None
    code: Node = Node("flat")
    id_map: bool = False
    refine: Spec | None = None

    def __str__(self) -> str:
        return self.text


_TRANSFORMS = [
    ("pca", r"PCA(W?)(R?)(\d+)"),
    ("l2norm", r"L2norm"),
    ("rotation", r"RR(\d+)?"),
    ("itq", r"ITQ(\d+)?"),
    ("opq", r"OPQ(\d+)(?:_(\d+))?"),
    ("pad", r"Pad(\d+)"),
]
_NORMS = r"(?:_N(float|none|qint8|qint4|cqint8|cqint4))?"
_COARSE = [
    ("ivf", r"IVF(\d+)"),
    ("ivf_hnsw", r"IVF(\d+)_HNSW(\d+)?"),
    ("ivf_nsg", r"IVF(\d+)_NSG(\d+)"),
    ("ivf_sub", r"IVF(\d+)\((.+)\)"),
    ("imi", r"IMI2x(\d+)"),
    ("residual_coarse", r"Residual(\d+)x(\d+)"),
    ("residual_coarse", r"Residual(\d+)"),
]
_CODES = [
    ("flat", r"Flat"),
    ("flat_dedup", r"FlatDedup"),
    ("sq", r"SQ(4|6|8|fp16)"),
    ("pq", r"PQ(\d+)(?:x(\d+))?(np)?"),
    ("pq_fast", r"PQ(\d+)x4fs(r?)(?:_(\d+))?"),
    ("pqr", r"PQ(\d+)\+(\d+)"),
    ("rq", r"RQ(\d+)x(\d+)" + _NORMS),
    ("lsq", r"LSQ(\d+)x(\d+)" + _NORMS),
]
_BASIC = [
    ("lsh", r"LSH(r?)(t?)"),
    ("lattice", r"ZnLattice(\d+)x(\d+)_(\d+)"),
    ("nsg", r"NSG(\d+)(?:,Flat)?"),
    ("hnsw", r"HNSW(\d+)(?:,(Flat|PQ\d+(?:np)?|SQ(?:4|6|8|fp16)|(?:2x)?\d+\+PQ\d+))?"),
    ("rq_coarse", r"RCQ(\d+)x(\d+)"),
    ("lsq_coarse", r"LSCQ(\d+)x(\d+)"),
]
_BINARY = [
    ("bivf_hnsw", r"BIVF(\d+)_HNSW(\d+)"),
    ("bivf", r"BIVF(\d+)"),
    ("bhnsw", r"BHNSW(\d+)"),
    ("bmultihash", r"BHash(\d+)x(\d+)"),
    ("bhash", r"BHash(\d+)"),
    ("bflat", r"BFlat"),
]


def _match(text: str, table: list[tuple[str, str]]) -> Node | None:
    for kind, pattern in table:
        if m := re.fullmatch(pattern, text):
            return Node(kind, tuple(int(g) if g and g.isdigit() else g for g in m.groups()), text)
    return None


def _split(text: str) -> list[str]:
    """At commas outside parentheses."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if depth < 0:
            raise SpecError(f"unbalanced parenthesis in {text!r}")
        if c == "," and not depth:
            out.append(text[at:i])
            at = i + 1
    if depth:
        raise SpecError(f"unbalanced parenthesis in {text!r}")
    return [*out, text[at:]]


def parse(text: str) -> Spec:
    items = [t.strip() for t in _split(text)]
    refined = None
    if items[-1] == "RFlat":
        refined, items = parse("Flat"), items[:-1]
    elif m := re.fullmatch(r"Refine\((.+)\)", items[-1]):
        refined, items = parse(m[1]), items[:-1]
    steps = []
    while len(items) > 1 and (node := _match(items[0], _TRANSFORMS)):
        steps.append(node)
        items = items[1:]
    id_map = "IDMap" in (items[0], items[-1])
    items = [i for i in items if i != "IDMap"]
    if not items:
        raise SpecError(f"nothing to index in {text!r}")
    coarse, body = None, ",".join(items)
    code = _match(body, _BASIC) or (_match(body, _CODES) if body != "FlatDedup" else None)
    if code is None and (coarse := _match(items[0], _COARSE)):
        rest = items[1:]
        if not rest:
            raise SpecError(f"{items[0]!r} needs a code")
        if m := re.fullmatch(r"SH(-?[\d.eE+]+)?([gcm])?", rest[-1]):
            step = _match(rest[0], _TRANSFORMS) if len(rest) == 2 else None
            code = Node("spectral", (step, float(m[1]) if m[1] else -1e10, m[2] or "c"), ",".join(rest))
        else:
            code = _match(",".join(rest), _CODES)
    if code is None:
        raise SpecError(f"cannot parse {text!r}")
    return Spec(text, tuple(steps), coarse, code, id_map, refined)


def parse_binary(text: str) -> Node:
    node = _match(text, _BINARY)
    if node is None:
        raise SpecError(f"cannot parse {text!r}")
    return node


# --- building -------------------------------------------------------------------------


@dataclass
class Index:
    """A fitted specification.  ``rows`` is the stored table: (id, vec) for flat bodies,
    (id, code) for codes, with list_no under a coarse stage."""

    spec: Spec
    d: int
    metric: str
    chain: transforms.Chain
    centroids: np.ndarray | None = None
    codec: codecs.Codec | None = None
    by_residual: bool = False
    rows: DataFrame | None = None
    exact: DataFrame | None = None
    edges: DataFrame | None = None
    instances: DataFrame | None = None
    refine_index: Index | None = None
    extra: dict = field(default_factory=dict)

    def add(self, df: DataFrame) -> Index:
        """Encode (id, vec) rows and append them."""
        df = df.select("id", "vec")
        if self.spec.code.kind == "flat_dedup":
            return self._add_distinct(df)
        moved = self.chain.apply(df) if self.chain.steps else df
        if self.spec.code.kind == "hnsw" and "storage" in self.extra:  # distances from decoded rows
            store = self.extra["storage"]
            moved = store.decode(store.encode(moved).drop("vec")).select("id", "vec")
        new = self._encode(moved)
        rows = new if self.rows is None else self.rows.drop("shard").unionByName(new)
        exact = df if self.exact is None else self.exact.unionByName(df)
        out = replace(self, rows=rows, exact=exact)
        if self.spec.code.kind in ("hnsw", "nsg"):
            sharded = graph.with_shards(rows)
            build = graph.hnsw_build(sharded, self.spec.code.args[0], metric=self.metric) if self.spec.code.kind == "hnsw" else graph.nsg_build(sharded, self.spec.code.args[0])
            out.edges, out.rows = build, sharded
        if self.refine_index is not None:
            out.refine_index = self.refine_index.add(df)
        return out

    def _add_distinct(self, df: DataFrame) -> Index:
        """Identical vectors are stored once, under their smallest id; ``instances`` has the
        ids of all of them."""
        exact = df if self.exact is None else self.exact.unionByName(df)
        once, instances = ivf.deduplicate(self.chain.apply(exact) if self.chain.steps else exact)
        return replace(self, rows=self._encode(once), exact=exact, instances=instances)

    def reset(self) -> Index:
        """Without rows, still fitted."""
        empty = self.refine_index.reset() if self.refine_index is not None else None
        return replace(self, rows=None, exact=None, edges=None, instances=None, refine_index=empty)

    def clone(self) -> Index:
        """A copy that later additions to either leave alone; matrices are copied too."""
        return replace(self, centroids=None if self.centroids is None else self.centroids.copy(), codec=copy.deepcopy(self.codec), chain=copy.deepcopy(self.chain))

    def probe(self, queries: DataFrame, nprobe: int) -> DataFrame:
        """Probes of transformed queries: all centroids are compared, or searched by the
        index that the coarse stage names."""
        kind, a = self.spec.coarse.kind, self.spec.coarse.args
        inner = {"ivf_hnsw": lambda: f"HNSW{a[1] or 32}", "ivf_nsg": lambda: f"NSG{a[1]}", "ivf_sub": lambda: a[1]}.get(kind)
        if inner is None:
            return ivf.probe(queries, self.centroids, nprobe, self.metric)
        table = centroid_table(queries.sparkSession, self.centroids).select(F.col("list_no").cast("long").alias("id"), "vec")
        found = build(inner(), table, self.metric).add(table).search(queries, nprobe, nprobe=nprobe, ef=2 * nprobe)
        return found.select("qid", F.col("rank").alias("probe"), F.col("id").cast("int").alias("list_no"), F.col("distance").alias("coarse_distance"))

    def _encode(self, df: DataFrame) -> DataFrame:
        if self.centroids is None:
            return self.codec.encode(df).select("id", "code") if self.codec else df.select("id", "vec")
        listed = ivf.add(df, self.centroids, self.metric)
        if isinstance(self.codec, codecs.SpectralCodec):
            return self.codec.encode(listed).select("id", "list_no", "code")
        if self.codec is None:
            return listed.select("id", "list_no", "vec")
        if self.by_residual:
            listed = residuals(listed, self.centroids)
        return self.codec.encode(listed).select("id", "list_no", "code")

    def search(self, queries: DataFrame, k: int, nprobe: int = 1, max_codes: int = 0, ef: int = 16, k_factor: float = 1.0, ht: int | None = None) -> DataFrame:
        """Top k.  nprobe, max_codes: of inverted lists; ef: of graphs; k_factor: candidates
        of a refinement; ht: the Hamming threshold of polysemous product codes."""
        if ht is not None and not isinstance(self.codec, codecs.ProductQuantizer):
            raise SpecError(f"{self.spec} has no polysemous codes")
        if self.refine_index is not None:
            found = replace(self, refine_index=None).search(queries, refine.base_k(k, k_factor), nprobe, max_codes, ef, ht=ht)
            better = self.refine_index.exact if self.refine_index.codec is None else self.refine_index.codec.decode(self.refine_index.rows)
            return refine.refine(found, queries, better.select("id", "vec"), k, self.metric)
        q = self.chain.apply(queries) if self.chain.steps else queries
        if self.edges is not None:
            return graph.graph_search(q, self.rows, self.edges, k, ef, self.metric)
        if self.centroids is None:
            if ht is not None:
                return self.codec.search(q, self.rows, k, self.metric, "polysemous", ht)
            found = self.codec.search(q, self.rows, k, self.metric) if self.codec else knn.knn(q, self.rows, k, self.metric)
        else:
            found = self._probed(q, k, nprobe, max_codes, None, ht)
        return found if self.instances is None else ivf.expand_duplicates(found, self.instances, k, self.metric)

    def _probed(self, q: DataFrame, k: int | None, nprobe: int, max_codes: int, radius: float | None, ht: int | None = None) -> DataFrame:
        probes = self.probe(q, nprobe)
        if max_codes:
            probes = ivf.cut_probes(probes, self.rows, max_codes)
        if self.codec is None:
            return ivf.search(q, self.rows, probes, k, self.metric, radius=radius)
        residual = self.centroids if self.by_residual else None
        scorer = self.codec.list_scorer(self.metric, residual) if ht is None else self.codec.list_scorer(self.metric, residual, ht)
        order = "l2" if isinstance(self.codec, codecs.SpectralCodec) else self.metric
        return ivf.search(q, self.rows, probes, k, order, radius=radius, scorer=scorer, payload=["code"])

    def range_search(self, queries: DataFrame, radius: float, nprobe: int = 1, max_codes: int = 0) -> DataFrame:
        """All rows strictly within the radius (qid, id, distance), by stored codes."""
        if self.edges is not None or isinstance(self.codec, codecs.SignCodec):
            raise SpecError(f"{self.spec} has no search by radius")
        q = self.chain.apply(queries) if self.chain.steps else queries
        if self.centroids is not None:
            found = self._probed(q, None, nprobe, max_codes, radius)
        else:
            found = knn.range_join(q, self.codec.decode(self.rows).select("id", "vec") if self.codec else self.rows, radius, self.metric)
        if self.instances is None:
            return found
        return found.withColumnRenamed("id", "rep").join(self.instances, "rep").select("qid", "id", "distance")

    def remove(self, selector) -> Index:
        from .maintain import remove_ids

        left = remove_ids(self.exact, selector)
        if self.edges is not None or self.instances is not None:  # what is stored depends on all rows
            return self.reset().add(left)
        return replace(self, rows=remove_ids(self.rows, selector), exact=left)

    def reconstruct(self, ids=None) -> DataFrame:
        """(id, vec) of stored rows, decoded and transformed back."""
        rows = self.rows if ids is None else self.rows.filter(F.col("id").isin(list(ids)))
        if self.codec is not None:
            rows = self.codec.decode(rows)
            if self.by_residual:
                rows = residuals(rows, self.centroids, sign=1.0)
        rows = rows.select("id", "vec")
        return self.chain.reverse(rows) if self.chain.steps else rows


def residuals(df: DataFrame, centroids: np.ndarray, sign: float = -1.0) -> DataFrame:
    """vec minus (or plus) the row's centroid: a join with the small centroid table."""
    table = centroid_table(df.sparkSession, sign * centroids).withColumnRenamed("vec", "_c")
    from ..functions.vector import add

    return df.join(F.broadcast(table), "list_no").withColumn("vec", add(F.col("vec"), F.col("_c"))).drop("_c")


def _transform(node: Node, df: DataFrame, d: int) -> tuple[transforms.Transform, int]:
    a = node.args
    if node.kind == "pca":
        return transforms.pca(df, a[2], -0.5 if a[0] else 0.0, rotate=bool(a[1])), a[2]
    if node.kind == "l2norm":
        return transforms.Normalise(), d
    if node.kind == "rotation":
        return transforms.random_rotation(d, a[0] or d), a[0] or d
    if node.kind == "itq":
        return transforms.itq(df, a[0] or d), a[0] or d
    if node.kind == "opq":
        return transforms.opq(df, a[0], a[1]), a[1] or d
    return transforms.Remap.pad(d, a[0]), a[0]


def _codec(node: Node, df: DataFrame, d: int) -> codecs.Codec | None:
    a = node.args
    if node.kind in ("flat", "hnsw", "nsg", "flat_dedup"):
        return None
    if node.kind == "sq":
        return codecs.ScalarQuantizer.train(df, {"4": "4bit", "6": "6bit", "8": "8bit"}.get(str(a[0]), "fp16"))
    if node.kind == "pq":
        return codecs.ProductQuantizer.train(df, a[0], a[1] or 8)
    if node.kind == "pq_fast":
        return codecs.FastScan(codecs.ProductQuantizer.train(df, a[0], 4).books)
    if node.kind == "pqr":
        return codecs.RefinedCodec.train(df, a[0], a[1])
    if node.kind == "lsh":
        return codecs.SignCodec.train(df, rotate=bool(a[0]), medians=bool(a[1]))
    if node.kind in ("rq", "rq_coarse"):
        return codecs.ResidualQuantizer.train(df, a[0], a[1])
    if node.kind in ("lsq", "lsq_coarse"):
        return codecs.LocalSearchQuantizer.fit(codecs.sample_matrix(df), a[0], a[1])
    if node.kind == "lattice":
        return codecs.LatticeCodec.train(df, a[0], a[1], a[2])
    raise SpecError(f"{node.text!r} has no codec of its own")


def build(text: str, train: DataFrame, metric: str = "l2", niter: int = 10) -> Index:
    """Fit an index on (id, vec) rows; nothing is stored until ``add``."""
    spec = parse(text)
    d = train.select(F.max(F.size("vec"))).first()[0]
    steps, width, df = [], d, train
    for node in spec.transforms:
        step, width = _transform(node, df, width)
        steps.append(step)
        df = step.apply(df)
    centroids = None
    if spec.coarse is not None:
        a = spec.coarse.args
        if spec.coarse.kind.startswith("ivf"):
            centroids = ivf.train(df, a[0], metric, niter=niter)
        elif spec.coarse.kind == "imi":
            if a[0] > MOST_IMI_BITS:
                raise SpecError(f"{spec.coarse.text}: 4 ** {a[0]} cells; use ivf.multi_index_probe with the two books")
            half = codecs.ProductQuantizer.train(df, 2, a[0])
            n = half.books.shape[1]
            centroids = np.array([np.concatenate((half.books[0][c % n], half.books[1][c // n])) for c in range(n * n)])
        else:
            rq = codecs.ResidualQuantizer.train(df, *(a if len(a) == 2 else (1, a[0])))
            n = [len(b) for b in rq.books]
            centroids = rq.decode_matrix(np.stack(np.unravel_index(np.arange(int(np.prod(n))), n), 1))
    by_residual = spec.coarse is not None and spec.code.kind in ("pq", "pq_fast", "pqr", "rq", "lsq") and metric == "l2"
    rows = df
    if by_residual:
        rows = residuals(ivf.add(df, centroids, metric), centroids)
    if spec.code.kind == "spectral":
        node, period, kind = spec.code.args
        step = _transform(node, df, width)[0] if node else transforms.Linear(np.eye(width))
        codec = codecs.SpectralCodec.train(df, step, centroids, period, kind)
    else:
        codec = _codec(spec.code, rows.select("id", "vec"), width)
    extra = {}
    if spec.code.kind == "hnsw" and spec.code.args[1] not in (None, "Flat"):
        name = re.sub(r"^(?:2x)?(\d+)\+PQ(\d+)$", r"PQ\2", spec.code.args[1])
        extra["storage"] = _codec(_match(name, _CODES), rows.select("id", "vec"), width)
    refine_index = build(spec.refine.text, train, metric) if spec.refine else None
    return Index(spec, d, metric, transforms.Chain(steps), centroids, codec, by_residual, refine_index=refine_index, extra=extra)


# --- binary ---------------------------------------------------------------------------


@dataclass
class BinaryIndex:
    """A binary specification over (id, code) rows of ``d`` bits."""

    node: Node
    d: int
    rows: DataFrame

    def search(self, queries: DataFrame, k: int, nprobe: int = 1, nflip: int = 0, ef: int = 16) -> DataFrame:
        from . import binary

        kind, a = self.node.kind, self.node.args
        if kind == "bflat":
            return binary.hamming_knn(queries, self.rows, k)
        if kind == "bhash":
            return binary.hash_knn(queries, self.rows, k, a[0], nflip)
        if kind == "bmultihash":
            return binary.hash_knn(queries, self.rows, k, a[1], nflip, a[0])
        if kind in ("bivf", "bivf_hnsw"):
            return binary.binary_ivf_search(queries, self.rows, self.d, a[0], nprobe, k)
        real = graph.with_shards(binary.to_real(self.rows, self.d).select("id", "vec"))
        asked = binary.to_real(queries, self.d).select("qid", "vec")
        found = graph.graph_search(asked, real, graph.hnsw_build(real, a[0]), k, ef)
        return found.withColumn("distance", F.round(F.col("distance") / 4).cast("int"))

    def range_search(self, queries: DataFrame, radius: int, nflip: int = 0) -> DataFrame:
        from . import binary

        kind, a = self.node.kind, self.node.args
        if kind == "bhash":
            return binary.hash_range(queries, self.rows, radius, a[0], nflip)
        if kind == "bmultihash":
            return binary.hash_range(queries, self.rows, radius, a[1], nflip, a[0])
        return binary.hamming_range(queries, self.rows, radius)


def replica_search(replicas: list[Index], queries: DataFrame, k: int, **settings) -> DataFrame:
    """Every replica holds all rows and answers its share of the queries."""
    n, out = len(replicas), None
    for i, index in enumerate(replicas):
        found = index.search(queries.filter(F.pmod(F.xxhash64("qid"), F.lit(n)) == i), k, **settings)
        out = found if out is None else out.unionByName(found)
    return out


def build_binary(text: str, rows: DataFrame, d: int) -> BinaryIndex:
    return BinaryIndex(parse_binary(text), d, rows)
