"""Line deduplication with a log-template tree (DataFrame only).

Lines are parsed to a fixed depth: variable fields (tokens with a digit, an ``@`` or a
``://``) become ``<*>``; the first level of the tree is the token count, the next
``depth`` levels are the leading tokens.  A leaf holds as many templates as its lines
need.  With v variable fields allowed, a line's tokens after the leading ones are cut into
v + 1 segments; lines of one template agree on a whole segment, so lines that share none
with another line of the leaf are their own template.  Among the others, tokens are
counted at each position of the leaf, and a line's constants are its leading tokens and
those of its other tokens that are at least as frequent at their place as its
(``similarity`` x tokens)-th most frequent one; the rest are variable fields.  Lines with the same constants at the same places share a template,
so a family of lines is found whatever else its leaf holds, and two lines of a template
agree on at least ``similarity`` of their tokens.  A template found in more than one
document is recurring: its first line (smallest identifier, then position) stays, all
others are dropped.

Scale: the tree is held as hashed rows (leaf, and 128 bits of line and template), counted
by partial aggregation, so a line that is in every document is a single row per task.
Segments, hashed, are compared only in leaves with several different lines; a bounded
bitmap filter of shared ones picks the lines whose tokens are counted.  Where rows meet the one
row of their key, keys with very many rows (at most BROADCAST_ROWS of them) are broadcast
and only the others shuffle, so no key is a hot partition.  Lists of positions are
broadcast only after the positions in them were counted.

Defined results: lines are separated by ``\\n`` and have ``[\\x20\\x09-\\x0D]+`` between
tokens; blank lines and lines of variable fields alone always stay; repeats within a
single document stay; null text stays null, empty text stays empty; rows that repeat
identifier and text are one document; ties of position cannot occur, equal identifiers go
by text hash; null identifiers sort last; lines and texts may have any length; an empty
table gives an empty result; ``emptied`` marks documents that lost lines and have no line
left that is not blank; result names replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, documents, durable, few, filter_bits, fresh, make_filter, meet, passing, without

GAP = r"[ \t\x0B\f\r]+"
VARIABLE = r"[0-9@]|://"
DEPTH, SIMILARITY = 3, 0.8
#: Positions in all lists of lines, up to which the lists are broadcast.
BROADCAST_POSITIONS = 8_000_000
LINE = ["leaf", "line", "line2"]


def _plain(text: Column) -> Column:
    """Blanks other than line ends as spaces."""
    for c in "\t\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def _masked(raw: Column) -> Column:
    """Tokens of a line of ``_plain`` text, variable fields as <*>."""
    tokens = F.array_remove(F.split(raw, " "), "")
    masked = F.transform(tokens, lambda t: F.when(t.rlike(VARIABLE), F.lit("<*>")).otherwise(t))
    return F.when(raw.rlike("[0-9@]") | F.contains(raw, F.lit("://")), masked).otherwise(tokens)


def _lines(docs: DataFrame, id_col: str, text_col: str, depth: int) -> DataFrame:
    """One row per line with a constant token: d, rk, pos, leaf, line, line2; hashes only,
    so that texts are parsed once."""
    rows = docs.select(
        F.col(f"`{id_col}`").alias("d"),
        F.xxhash64(f"`{id_col}`", f"`{text_col}`").alias("rk"),
        F.posexplode(F.split(_plain(F.col(f"`{text_col}`")), "\n")).alias("pos", "raw"),
    )
    rows = rows.select("d", "rk", "pos", _masked(F.col("raw")).alias("masked")).filter(F.exists("masked", lambda t: t != "<*>"))
    leaf = F.xxhash64(F.size("masked"), F.slice("masked", 1, depth))
    line, line2 = F.xxhash64("masked"), F.xxhash64(F.lit(1), "masked")
    return durable(rows.select("d", "rk", "pos", leaf.alias("leaf"), line.alias("line"), line2.alias("line2")), "lines")


def _bound_lists(lists: DataFrame, column: str) -> DataFrame:
    """A stored table of lists, to be broadcast if rows and positions are few."""
    rows, positions = lists.agg(F.count(F.lit(1)), F.sum(F.size(column))).first()
    return F.broadcast(lists) if rows <= BROADCAST_ROWS and (positions or 0) <= BROADCAST_POSITIONS else lists


def _members(docs: DataFrame, id_col: str, text_col: str, known: DataFrame) -> DataFrame:
    """(leaf, line, line2, tokens) of the different lines of leaves that have several, each
    from its first document: those documents are split again, and only these lines parsed."""
    wanted = known.filter("several").select(*LINE, F.col("first.rk").alias("rk"), F.col("first.pos").alias("pos"))
    wanted = durable(wanted.groupBy("rk").agg(F.collect_list(F.struct("pos", *LINE)).alias("w")), "wanted")
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.xxhash64(f"`{id_col}`", text).alias("rk"), text.alias("text")).join(_bound_lists(wanted, "w"), "rk")
    rows = rows.select(F.split(_plain(F.col("text")), "\n").alias("parts"), "w").select(
        F.explode(F.transform("w", lambda x: F.struct(*[x[c].alias(c) for c in LINE], F.get("parts", x["pos"]).alias("raw")))).alias("x")
    )
    tokens = F.transform(_masked(F.col("x.raw")), lambda t: F.xxhash64(t))
    rows = rows.select(*[f"x.{c}" for c in LINE], tokens.alias("tokens"))
    return durable(rows.groupBy(*LINE).agg(F.min("tokens").alias("tokens")), "members")


def _asked(n: Column, similarity: float) -> Column:
    """Constants that a template of n tokens has at least."""
    return F.ceil(F.round(F.lit(similarity) * n, 6)).cast("int")


def _sharing(members: DataFrame, depth: int, similarity: float) -> DataFrame:
    """``members`` that have a whole segment in common with another line of their leaf."""
    n = F.size("tokens")
    cuts, rest = n - _asked(n, similarity) + 1, n - depth
    at = lambda i: F.floor(i * rest / cuts).cast("int")
    segments = F.transform(F.sequence(F.lit(0), cuts - 1), lambda i: F.xxhash64("leaf", i, F.slice("tokens", at(i) + depth + 1, at(i + 1) - at(i))))
    rows = members.filter(n > depth).select(*LINE, F.explode(segments).alias("h"))
    shared = rows.groupBy("h").agg(F.min("line").alias("lo"), F.max("line").alias("hi")).filter("lo <> hi").select("h")
    shared = durable(shared, "shared")
    bits = filter_bits(shared.count())
    near = passing(rows, F.col("h"), durable(make_filter(shared, bits), "filter"), bits)
    near = near.join(F.broadcast(shared) if few(shared) else shared, "h", "left_semi")
    near = durable(near.groupBy(*LINE).agg(F.lit(True).alias("near")).drop("near"), "near")
    return durable(members.join(F.broadcast(near) if few(near) else near, LINE, "left_semi"), "sharing")


def _templates(members: DataFrame, depth: int, similarity: float) -> DataFrame:
    """(line, line2, t1, t2): the template of each line that shares a segment."""
    members = _sharing(members, depth, similarity)
    # a token at its place in its leaf is one hash, k
    ks = F.transform(F.slice("tokens", depth + 1, F.size("tokens")), lambda t, i: F.xxhash64("leaf", i, t))
    places = members.select("line", "line2", F.explode(ks).alias("k"))
    counts = durable(places.groupBy("k").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "counts")
    places = meet(places, counts, ["k"], "c", "left").withColumn("c", F.coalesce("c", F.lit(1).cast("long")))
    per = places.groupBy("line", "line2").agg(F.sort_array(F.collect_list(F.struct("c", "k")), asc=False).alias("x"))
    asked = _asked(F.size("x") + depth, similarity) - depth
    cut = F.when(asked > 0, F.get("x", asked - 1)["c"])
    constants = F.transform(F.filter("x", lambda x: F.coalesce(x["c"] >= cut, F.lit(False))), lambda x: x["k"])
    return per.select("line", "line2", F.xxhash64(constants).alias("t1"), F.xxhash64(F.lit(1), constants).alias("t2"))


def recurring_templates(docs: DataFrame, id_col: str, text_col: str, lines: DataFrame, depth: int = DEPTH, similarity: float = SIMILARITY) -> DataFrame:
    """(leaf, line, line2, times, first) of each different line whose template is in
    several documents; times: how often the line occurs."""
    seqs = lines.groupBy(*LINE).agg(
        F.min("rk").alias("lo"),
        F.max("rk").alias("hi"),
        F.count(F.lit(1)).alias("times"),
        F.min(F.struct(F.col("d").isNull().alias("n"), "d", "rk", "pos")).alias("first"),
    )
    leaves = lines.groupBy("leaf").agg(F.min("line").alias("a"), F.max("line").alias("b"))
    leaves = durable(leaves.filter("a <> b").select("leaf", F.lit(True).alias("several")), "leaves")
    known = seqs.join(F.broadcast(leaves) if few(leaves) else leaves, "leaf", "left").filter("lo <> hi OR several")
    known = durable(known, "templates")
    found = _templates(_members(docs, id_col, text_col, known), depth, similarity)
    marked = known.filter("several").join(found, ["line", "line2"], "left")
    # lines that share no segment are their own template
    marked = marked.withColumn("t1", F.coalesce("t1", "line")).withColumn("t2", F.coalesce("t2", "line2"))
    marked = durable(marked.drop("several"), "marked")
    template = ["leaf", "t1", "t2"]
    groups = marked.groupBy(*template).agg(F.min("lo").alias("glo"), F.max("hi").alias("ghi"), F.min("first").alias("gfirst"), F.count(F.lit(1)).alias("rows"))
    groups = durable(groups.filter("glo <> ghi").drop("glo", "ghi"), "groups")
    shared = meet(marked, groups, template, "rows", "inner").select(*LINE, "times", F.col("gfirst").alias("first"))
    own = known.filter("several IS NULL").select(*LINE, "times", "first")
    return own.unionByName(shared)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the text without dropped lines, and n_lines, n_dropped, emptied."""
    docs = without(docs, "n_lines", "n_dropped", "emptied")
    lines = _lines(docs, id_col, text_col, depth)
    keys = durable(recurring_templates(docs, id_col, text_col, lines, depth, similarity), "recurring")
    dropped = lines.join(F.broadcast(keys), LINE) if few(keys) else meet(lines, keys, LINE, "times", "inner")
    drops = dropped.filter("rk <> first.rk OR pos <> first.pos").groupBy("d", "rk").agg(F.collect_set("pos").alias("dropped"))
    drops = _bound_lists(durable(drops, "drops"), "dropped")
    rk, dk, dd, dr, parts, left = fresh(docs, "rk", "dk", "d", "dropped", "parts", "left")
    text = F.col(f"`{text_col}`")
    out = docs.withColumn(rk, F.xxhash64(f"`{id_col}`", text)).join(
        drops.select(F.col("d").alias(dd), F.col("rk").alias(dk), F.col("dropped").alias(dr)),
        (F.col(rk) == F.col(dk)) & F.col(f"`{id_col}`").eqNullSafe(F.col(dd)),
        "left",
    )
    out = out.withColumn(parts, F.split(text, "\n"))
    keep = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(dr))
    out = out.withColumn(left, F.when(F.col(dr).isNotNull(), F.transform(keep, lambda i: F.get(F.col(parts), i))))
    return out.select(
        *[(F.coalesce(F.array_join(left, "\n"), text).alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns],
        F.when(text.isNull(), 0).otherwise(F.size(parts)).alias("n_lines"),
        F.when(F.col(dr).isNull(), 0).otherwise(F.size(dr)).alias("n_dropped"),
        F.when(F.col(dr).isNull(), False).otherwise(~F.exists(left, lambda x: x.rlike(r"[^ \t\x0B\f\r]"))).alias("emptied"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "emptied", "text")


OP3_SQL = rf"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS raw
  FROM documents),
t AS (
  SELECT doc_id, pos,
    list_transform(list_filter(regexp_split_to_array(raw, '{GAP}'), lambda x: x <> ''),
      lambda x: CASE WHEN regexp_matches(x, '{VARIABLE}') THEN '<*>' ELSE x END) AS masked
  FROM l),
e AS (
  SELECT doc_id, pos, masked, len(masked) AS n, masked[1:{DEPTH}] AS lead
  FROM t WHERE len(list_filter(masked, lambda x: x <> '<*>')) > 0),
s AS (SELECT n, lead, masked, min((doc_id, pos)) AS first FROM e GROUP BY ALL),
q AS (SELECT n, lead, masked, n - ceil(round({SIMILARITY} * n, 6))::BIGINT + 1 AS cuts, n - {DEPTH} AS rest FROM s WHERE n > {DEPTH}),
f AS (SELECT n, lead, masked, i, masked[{DEPTH} + i * rest // cuts + 1 : {DEPTH} + (i + 1) * rest // cuts] AS segment FROM q, LATERAL (SELECT unnest(range(0, cuts)) AS i)),
j AS (SELECT n, lead, i, segment FROM f GROUP BY ALL HAVING count(*) > 1),
y AS (SELECT DISTINCT n, lead, masked FROM f JOIN j USING (n, lead, i, segment)),
x AS (SELECT n, lead, masked, generate_subscripts(masked, 1) AS p, unnest(masked) AS t FROM y),
v AS (SELECT n, lead, p, t, count(*) AS c FROM x WHERE p > {DEPTH} GROUP BY ALL),
w AS (SELECT n, lead, masked, list(c ORDER BY p) AS cs FROM x JOIN v USING (n, lead, p, t) GROUP BY ALL),
m AS (
  SELECT s.n, s.lead, s.masked, s.first,
    CASE WHEN cs IS NULL THEN s.masked ELSE list_transform(range(1, len(cs) + 1), lambda i:
      CASE WHEN cs[i] >= list_reverse_sort(cs)[CAST(ceil(round({SIMILARITY} * s.n, 6)) AS INT) - {DEPTH}] THEN s.masked[i + {DEPTH}] ELSE '' END) END AS template
  FROM s LEFT JOIN w USING (n, lead, masked)),
g AS (
  SELECT n, lead, template, min(m.first) AS first, count(DISTINCT doc_id) AS docs
  FROM e JOIN m USING (n, lead, masked) GROUP BY n, lead, template),
r AS (
  SELECT e.doc_id, e.pos FROM e JOIN m USING (n, lead, masked) JOIN g USING (n, lead, template)
  WHERE g.docs > 1 AND (e.doc_id, e.pos) <> g.first),
d AS (SELECT doc_id, list(pos) AS dropped FROM r GROUP BY doc_id),
o AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS parts, dropped,
    [string_split(text, chr(10))[i] for i in range(1, len(string_split(text, chr(10))) + 1) if NOT list_contains(dropped, i - 1)] AS kept
  FROM documents LEFT JOIN d USING (doc_id))
SELECT doc_id, len(parts)::INT AS n_lines, coalesce(len(dropped), 0)::INT AS n_dropped,
  dropped IS NOT NULL AND NOT list_bool_or(list_transform(kept,
    lambda y: len(list_filter(regexp_split_to_array(y, '{GAP}'), lambda z: z <> '')) > 0) || [false]) AS emptied,
  CASE WHEN dropped IS NULL THEN text ELSE array_to_string(kept, chr(10)) END AS text
FROM o
"""
