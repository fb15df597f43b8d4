"""Queries over the driver's tables, one or more for each family of operators, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import dedup, generators, graph, local, pairs, structures
from ..operators.components import connected
from ..session import table, workspace, written
from ..streaming import incremental
from .samples import SQL_ATOMS, SQL_CELLS, chain_bonds, order_atoms, supplier_cells, supplier_crystals, supplier_molecules

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return put


def queries() -> dict[str, Query]:
    from . import chains, nations  # noqa: F401  add their own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import chains, nations  # noqa: F401

    return dict(SQL)


# Composition and moments

SQL_FORMULA = """
counted AS (SELECT struct_id, element, count(*) AS n FROM atoms GROUP BY ALL),
formulas AS (SELECT struct_id, string_agg(element || n, '' ORDER BY element) AS formula FROM counted GROUP BY struct_id)"""


@query(f"""WITH {SQL_ATOMS}, {SQL_FORMULA},
centre AS (
  SELECT struct_id, count(*) AS n_atoms, sum(mass)::DOUBLE AS mass, sum(mass * x)::DOUBLE / sum(mass)::DOUBLE AS com_x,
         sum(mass * y)::DOUBLE / sum(mass)::DOUBLE AS com_y, sum(mass * z)::DOUBLE / sum(mass)::DOUBLE AS com_z
  FROM atoms GROUP BY struct_id)
SELECT struct_id, formula, n_atoms, mass, com_x, com_y, com_z FROM centre JOIN formulas USING (struct_id)""")
def composition_com(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formula and centre of mass in one aggregation: counts by element are summed up from a list of an order's elements."""
    atoms = order_atoms(spark, sf_dir)
    total = F.sum("mass").cast("double")
    com = [(F.sum(F.col("mass") * F.col(c)).cast("double") / total).alias(f"com_{c}") for c in "xyz"]
    listed = atoms.groupBy("struct_id").agg(F.array_sort(F.collect_list("element")).alias("e"), F.count("*").alias("n_atoms"), total.alias("mass"), *com)
    part = F.transform(F.array_distinct("e"), lambda x: F.concat(x, F.size(F.filter("e", lambda y: y == x)).cast("string")))
    return listed.select("struct_id", F.array_join(part, "").alias("formula"), "n_atoms", "mass", "com_x", "com_y", "com_z")


@query(f"WITH {SQL_ATOMS} SELECT struct_id, element, count(*) AS n FROM atoms GROUP BY ALL")
def formula_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures.formula_counts(order_atoms(spark, sf_dir))


@query(f"WITH {SQL_ATOMS}, {SQL_FORMULA} SELECT formula, min(struct_id) AS struct_id, count(*) AS n FROM formulas GROUP BY formula")
def unique_by_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures.first_by_formula(order_atoms(spark, sf_dir))


@query(f"""WITH {SQL_ATOMS}, t AS (
  SELECT struct_id, sum(mass * (x*x + y*y + z*z))::DOUBLE AS total, sum(mass * (y*y + z*z))::DOUBLE AS xx, sum(mass * (x*x + z*z))::DOUBLE AS yy,
         sum(mass * (x*x + y*y))::DOUBLE AS zz, sum(-mass * x * y)::DOUBLE AS xy, sum(-mass * x * z)::DOUBLE AS xz, sum(-mass * y * z)::DOUBLE AS yz
  FROM atoms GROUP BY struct_id)
SELECT struct_id, xx / total AS ixx, yy / total AS iyy, zz / total AS izz, xy / total AS ixy, xz / total AS ixz, yz / total AS iyz FROM t""")
def inertia_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures.inertia(order_atoms(spark, sf_dir))


@query(f"""WITH {SQL_ATOMS}, e AS (
  SELECT struct_id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM atoms GROUP BY struct_id)
SELECT struct_id, min_x::DOUBLE AS min_x, max_x::DOUBLE AS max_x, min_y::DOUBLE AS min_y, max_y::DOUBLE AS max_y, min_z::DOUBLE AS min_z, max_z::DOUBLE AS max_z,
       greatest((max_x - min_x)::DOUBLE, (max_y - min_y)::DOUBLE, (max_z - min_z)::DOUBLE) / 2 AS scale FROM e""")
def extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = structures.extents(order_atoms(spark, sf_dir), F.lit(0).cast("decimal(4,2)"))
    return out.select("struct_id", *(F.col(c).cast("double").alias(c) for c in out.columns if c != "struct_id"))


@query(f"""WITH {SQL_CELLS} SELECT struct_id, a, b, c, 90.0::DOUBLE AS alpha, 90.0::DOUBLE AS beta, 90.0::DOUBLE AS gamma, a * b * c AS volume FROM cells""")
def lattice_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = structures.cells(supplier_cells(spark, sf_dir))
    return out.withColumns({c: F.round(c, 9) for c in ("alpha", "beta", "gamma")})


@query(f"""WITH {SQL_CELLS} SELECT struct_id, round(1.66053907 * ([12.011, 14.007, 15.999, 35.45])[struct_id % 4 + 1]::DOUBLE / (a * b * c), 9) AS density FROM cells""")
def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = supplier_cells(spark, sf_dir)
    return structures.density(cells.drop("lattice"), cells).withColumn("density", F.round("density", 9))


@query(f"""WITH {SQL_CELLS} SELECT struct_id, round(x / a - floor(x / a), 9) AS fa, round(y / b - floor(y / b), 9) AS fb, round(z / c - floor(z / c), 9) AS fc FROM cells""")
def fractional_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = supplier_cells(spark, sf_dir)
    out = structures.fractional(cells.drop("lattice"), cells, inside=True)
    return out.select("struct_id", *(F.round(c, 9).alias(c) for c in ("fa", "fb", "fc")))


@query(f"""WITH {SQL_CELLS} SELECT struct_id, round(x + 1, 9) AS x, round(-z + 2, 9) AS y, round(y + 3, 9) AS z FROM cells""")
def rotate_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = structures.translated(structures.rotated(supplier_cells(spark, sf_dir), G.euler_matrix(90, 0, 0)), (1, 2, 3))
    return atoms.select("struct_id", *((F.round(c, 9) + 0.0).alias(c) for c in "xyz"))


@query(f"""WITH {SQL_ATOMS}, c AS (SELECT struct_id, sum(mass * x)::DOUBLE / sum(mass)::DOUBLE AS cx FROM atoms GROUP BY struct_id)
SELECT struct_id, atom_idx, round(x::DOUBLE - cx, 6) + 0.0 AS x FROM atoms JOIN c USING (struct_id)""")
def centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = order_atoms(spark, sf_dir)
    com = structures.centres(atoms).select("struct_id", "com_x")
    return atoms.join(com, "struct_id").select("struct_id", "atom_idx", (F.round(F.col("x").cast("double") - F.col("com_x"), 6) + 0.0).alias("x"))


# Parts, unions, properties


@query(f"""WITH {SQL_ATOMS}, kept AS (
  SELECT struct_id, atom_idx AS old, (row_number() OVER (PARTITION BY struct_id ORDER BY atom_idx) - 1)::INTEGER AS atom_idx FROM atoms WHERE element = 'R'),
pairs AS (SELECT a.struct_id, a.atom_idx AS i, b.atom_idx AS j FROM kept a JOIN kept b ON a.struct_id = b.struct_id AND abs(a.old - b.old) = 1)
SELECT struct_id, i, j FROM pairs""")
def subset_bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = order_atoms(spark, sf_dir)
    return structures.subset(atoms, chain_bonds(atoms), atoms.where("element = 'R'"))[1]


@query(f"""WITH {SQL_ATOMS}
SELECT struct_id, (row_number() OVER (PARTITION BY struct_id ORDER BY CASE WHEN element = 'N' THEN 0 ELSE 1 END, atom_idx) - 1)::INTEGER AS atom_idx, element
FROM atoms""")
def combined_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = order_atoms(spark, sf_dir)
    return structures.combined(atoms.where("element = 'N'"), atoms.where("element <> 'N'")).select("struct_id", "atom_idx", "element")


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return structures.last_wins(rows, ["o_orderdate", "o_orderkey"], "o_custkey").drop("o_orderdate")


@query("""SELECT doc_id AS id, 'label' AS origin, quality AS value FROM labels UNION ALL
SELECT doc_id AS id, 'document' AS origin, NULL AS value FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("origin"), F.lit(None).cast("int").alias("value"))
    new = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit("label").alias("origin"), F.col("quality").alias("value"))
    return structures.upserted(old, new, "id")


@query("""SELECT event_id::VARCHAR AS struct_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') AS "none" FROM events""")
def property_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("struct_id"), F.from_json("props", "map<string,string>").alias("properties"))
    return structures.property_table(rows, ["k", "none"])


@query(f"""WITH {SQL_CELLS} SELECT 's' || struct_id AS struct_id, element, a, round(x, 6) AS x, 'box' AS cell_kind FROM cells""")
def document_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To JSON, with a key that readers don't know, and back."""
    cells = supplier_cells(spark, sf_dir).withColumn("struct_id", F.concat(F.lit("s"), "struct_id"))
    rows = structures.to_structures(cells, cells.select("struct_id", "lattice"))
    docs = structures.documents(rows).withColumn("doc", F.regexp_replace("doc", r"^\{", '{"cell_kind":"box",'))
    back = structures.from_documents(docs)
    return back.select("struct_id", F.col("elements")[0].alias("element"), F.col("lattice")[0][0].alias("a"), F.round(F.col("geometry")[0][0], 6).alias("x"), F.col("properties")["cell_kind"].alias("cell_kind"))


@query("""SELECT event_id, round((value - (SELECT min(value) FROM events)) / (0.010364 * 4), 6) AS energy_shift FROM events""")
def energy_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = structures.shifted_energy(table(spark, sf_dir, "events").select("event_id", "value"), "value")
    return rows.select("event_id", F.round("energy_shift", 6).alias("energy_shift"))


@query("""WITH edges AS (SELECT least(0.0, min(value)) AS lo, greatest(0.0, max(value)) AS hi FROM events)
SELECT event_type, least(floor((value - lo) / ((hi - lo) / 10))::INTEGER, 9) AS bin, count(*) AS n FROM events, edges GROUP BY ALL""")
def histogram_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures.aligned_histogram(table(spark, sf_dir, "events"), "event_type", "value")


# Pairs


@query("""SELECT a.s_suppkey AS id1, b.s_suppkey AS id2, abs(a.s_acctbal::DECIMAL(12,2) - b.s_acctbal::DECIMAL(12,2))::DOUBLE AS value,
abs(a.s_acctbal::DECIMAL(12,2) - b.s_acctbal::DECIMAL(12,2))::DOUBLE < 500 AS is_match, 'balance' AS op
FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey""")
def pairs_upper_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = pairs.unordered(balances(spark, sf_dir), "s_suppkey", ["s_nationkey"], ["bal"])
    apart = F.abs(F.col("bal1") - F.col("bal2")).cast("double")
    return pairs.scored(met, "balance", apart, apart < 500)


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.col("s_acctbal").cast("decimal(12,2)").alias("bal"))


@query("""WITH p AS (SELECT a.s_suppkey AS id1, b.s_suppkey AS id2, abs(a.s_acctbal::DECIMAL(12,2) - b.s_acctbal::DECIMAL(12,2))::DOUBLE AS value
  FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey)
SELECT id1, id2, value, n::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY value, id2) AS n FROM p) WHERE n <= 3""")
def nearest_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = pairs.both_sides(pairs_upper_triangle(spark, sf_dir))
    return pairs.nearest(both, 3).select("id1", "id2", "value", "rank")


SQL_NEAR = """
near AS (
  SELECT a.vec_id AS id1, b.vec_id AS id2, a.label AS label1, b.label AS label2, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d
  FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)"""


@query(f"WITH {SQL_NEAR} SELECT id1, id2, round(d, 6) AS value FROM near WHERE d < 1.2")
def neighbours_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = pairs.near_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", radius=1.2)
    return near.select("id1", "id2", F.round("value", 6).alias("value"))


@query(f"""WITH {SQL_NEAR}, both_ways AS (SELECT id1, id2, d FROM near UNION ALL SELECT id2, id1, d FROM near)
SELECT id1, id2, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY d, id2) AS rank FROM both_ways) WHERE rank <= 5""")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = pairs.near_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", k=5)
    return pairs.nearest(near, 5).select("id1", "id2", "rank")


@query(f"""WITH {SQL_NEAR} SELECT least(label1, label2) AS label1, greatest(label1, label2) AS label2, round(min(d), 6) AS d,
arg_min(id1, d) AS id1, arg_min(id2, d) AS id2 FROM near WHERE label1 <> label2 GROUP BY 1, 2""")
def min_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = pairs.near_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", keep=("label",), between="label")
    label = [f("label1", "label2").alias(f"label{n}") for n, f in ((1, F.least), (2, F.greatest))]
    return near.select(*label, F.round("value", 6).alias("d"), "id1", "id2")


@query(f"""WITH {SQL_CELLS}, steps AS (SELECT unnest(range(-3, 4)) AS s)
SELECT struct_id, count(*) AS n, round(min(sqrt(p.s*p.s*a*a + q.s*q.s*b*b + t.s*t.s*c*c)), 6) AS nearest
FROM cells, steps p, steps q, steps t
WHERE NOT (p.s = 0 AND q.s = 0 AND t.s = 0) AND sqrt(p.s*p.s*a*a + q.s*q.s*b*b + t.s*t.s*c*c) < 8.9 GROUP BY struct_id""")
def periodic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = supplier_cells(spark, sf_dir)
    near = pairs.periodic_neighbours(cells.drop("lattice"), cells, 8.9, 8.9)
    return near.groupBy("struct_id").agg(F.count("*").alias("n"), F.round(F.min("d"), 6).alias("nearest"))


@query(f"""WITH {SQL_ATOMS} SELECT a.struct_id, a.atom_idx AS i, b.atom_idx AS j FROM atoms a JOIN atoms b ON a.struct_id = b.struct_id AND a.atom_idx < b.atom_idx
WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 4000000""")
def points_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one order within a distance, by cells."""
    atoms = order_atoms(spark, sf_dir)
    points = atoms.select("struct_id", "atom_idx", "element", *(F.col(c).cast("double").alias(c) for c in "xyz"))
    return pairs.within(points, 2000.0, 2000.0).select("struct_id", "i", "j")


@query("""WITH r AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value) AS rank FROM events)
SELECT a.user_id, a.rank::INTEGER AS rank, round(abs(a.value - b.value), 6) AS cost FROM r a JOIN r b ON a.user_id = b.user_id AND a.rank = b.rank
WHERE a.event_type = (SELECT min(event_type) FROM events) AND b.event_type = (SELECT max(event_type) FROM events)""")
def rank_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    first, last = rows.agg(F.min("event_type"), F.max("event_type")).first()
    met = pairs.rank_matched(rows.where(F.col("event_type") == first), rows.where(F.col("event_type") == last), "user_id", "value")
    return met.select("user_id", "rank", F.round("cost", 6).alias("cost"))


# Graphs


@query(f"""WITH RECURSIVE {SQL_NEAR}, edges AS (SELECT id1, id2 FROM near WHERE d < 1.16 UNION ALL SELECT id2, id1 FROM near WHERE d < 1.16),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, edges.id2 FROM reach JOIN edges ON reach.other = edges.id1)
SELECT vec_id, min(other) AS component FROM reach GROUP BY vec_id""")
def embedding_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = pairs.near_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", radius=1.16)
    links = near.select(F.col("id1").alias("a"), F.col("id2").alias("b"))
    roots = connected(links, workspace(spark, "components")).select(F.col("node").alias("vec_id"), "root")
    out = table(spark, sf_dir, "embeddings").select("vec_id").join(roots, "vec_id", "left")
    return out.select("vec_id", F.coalesce("root", "vec_id").alias("component"))


@query(f"""WITH {SQL_ATOMS}, marked AS (
  SELECT *, CASE WHEN lag(element) OVER (PARTITION BY struct_id ORDER BY atom_idx) = element THEN 0 ELSE 1 END AS start FROM atoms)
SELECT struct_id, atom_idx, (sum(start) OVER (PARTITION BY struct_id ORDER BY atom_idx) - 1)::INTEGER AS mol_idx FROM marked""")
def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = order_atoms(spark, sf_dir)
    return graph.molecules(atoms, chain_bonds(atoms, same=True))


SQL_NAMED = f"""{SQL_ATOMS},
bonds AS (SELECT a.struct_id, a.atom_idx AS i, b.atom_idx AS j, b.element AS e FROM atoms a JOIN atoms b ON a.struct_id = b.struct_id AND abs(a.atom_idx - b.atom_idx) = 1),
named AS (SELECT a.struct_id, a.atom_idx, a.element || coalesce(string_agg(e, '' ORDER BY e), '') AS neighbourhood
  FROM atoms a LEFT JOIN bonds ON a.struct_id = bonds.struct_id AND a.atom_idx = i GROUP BY a.struct_id, a.atom_idx, a.element)"""


@query(f"WITH {SQL_NAMED} SELECT struct_id, neighbourhood, count(*) AS n FROM named GROUP BY ALL")
def bond_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = order_atoms(spark, sf_dir)
    return graph.fragments(graph.neighbourhoods(atoms.select("struct_id", "atom_idx", "element"), chain_bonds(atoms)))


@query(f"""WITH {SQL_NAMED}, shells AS (
  SELECT a.struct_id, a.atom_idx, abs(a.atom_idx - b.atom_idx) AS hop, string_agg(b.neighbourhood, '' ORDER BY b.neighbourhood) AS w
  FROM named a JOIN named b ON a.struct_id = b.struct_id AND abs(a.atom_idx - b.atom_idx) < 3 GROUP BY ALL)
SELECT struct_id, atom_idx, string_agg(w, '|' ORDER BY hop) AS descriptor FROM shells GROUP BY ALL""")
def descriptor_shells(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = order_atoms(spark, sf_dir)
    bonds = chain_bonds(atoms)
    named = graph.neighbourhoods(atoms.select("struct_id", "atom_idx", "element"), bonds)
    return graph.descriptors(named, bonds, shells=3).select("struct_id", "atom_idx", "descriptor")


@query(f"""WITH {SQL_ATOMS}, p AS (SELECT struct_id, atom_idx, x::DOUBLE AS x, y::DOUBLE * 1000 AS y, z::DOUBLE * 1000 AS z FROM atoms),
arms AS (
  SELECT c.struct_id, a.atom_idx AS i, c.atom_idx AS centre, b.atom_idx AS j, a.x - c.x AS ax, a.y - c.y AS ay, a.z - c.z AS az, b.x - c.x AS bx, b.y - c.y AS by_, b.z - c.z AS bz
  FROM p c JOIN p a ON a.struct_id = c.struct_id AND a.atom_idx = c.atom_idx - 1 JOIN p b ON b.struct_id = c.struct_id AND b.atom_idx = c.atom_idx + 1)
SELECT struct_id, i, centre, j, round(degrees(acos(greatest(-1.0, least(1.0, (ax*bx + ay*by_ + az*bz) / (sqrt(ax*ax + ay*ay + az*az) * sqrt(bx*bx + by_*by_ + bz*bz)))))), 4) AS angle
FROM arms""")
def bond_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = order_atoms(spark, sf_dir)
    scaled = atoms.select("struct_id", "atom_idx", "element", F.col("x").cast("double").alias("x"), *((F.col(c).cast("double") * 1000).alias(c) for c in "yz"))
    return graph.bond_angles(scaled, chain_bonds(atoms)).select("struct_id", "i", "centre", "j", F.round("angle", 4).alias("angle"))


# De-duplication


@query("SELECT text, min(doc_id) AS leader, count(*) AS n FROM documents GROUP BY text")
def leaders_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.unique_by_key(table(spark, sf_dir, "documents"), "text", "doc_id")


@query("SELECT text, min(doc_id) AS leader, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.unique_by_key(table(spark, sf_dir, "documents"), "text", "doc_id", keep_single=False)


SQL_LEADERS = f"""{SQL_NEAR},
adj AS (SELECT id1, list(id2) AS others FROM (SELECT id1, id2 FROM near WHERE d < 1.2 UNION ALL SELECT id2, id1 FROM near WHERE d < 1.2) GROUP BY id1),
nodes AS (SELECT vec_id, coalesce(others, []) AS others, row_number() OVER (ORDER BY vec_id) AS ord FROM embeddings LEFT JOIN adj ON id1 = vec_id),
walk(ord, used, led) AS (
  SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[]
  UNION ALL
  SELECT n.ord, CASE WHEN list_contains(used, n.vec_id) THEN used ELSE list_concat(used, n.others) END,
         CASE WHEN list_contains(used, n.vec_id) THEN led ELSE list_append(led, n.vec_id) END
  FROM walk JOIN nodes n ON n.ord = walk.ord + 1),
leaders AS (SELECT unnest(led) AS leader FROM walk WHERE ord = (SELECT max(ord) FROM nodes))"""


@query(f"""WITH RECURSIVE {SQL_LEADERS}
SELECT leader, leader AS member FROM leaders UNION ALL SELECT leader, unnest(others) AS member FROM leaders JOIN nodes ON vec_id = leader""")
def leader_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaders in order with all linked to them; singles kept."""
    return dedup.unique_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "vec_id", 1.2, keep_single=True)


@query(f"""WITH RECURSIVE {SQL_LEADERS}
SELECT leader, leader AS member FROM leaders JOIN nodes ON vec_id = leader WHERE len(others) > 0
UNION ALL SELECT leader, unnest(others) AS member FROM leaders JOIN nodes ON vec_id = leader""")
def leader_groups_without_singles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.unique_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "vec_id", 1.2, keep_single=False)


@query("""WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM documents)
SELECT doc_id, n_chars, rank, (CASE WHEN (rank // 8) % 2 = 0 THEN rank % 8 ELSE 7 - rank % 8 END)::INTEGER AS part FROM r""")
def split_by_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.balanced(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", 8, "doc_id").select("doc_id", "n_chars", "rank", "part")


# Generators


@query(f"""WITH {SQL_CELLS}, s2 AS (SELECT unnest(range(0, 2)) AS s), s3 AS (SELECT unnest(range(0, 3)) AS s)
SELECT struct_id, p.s::INTEGER AS na, q.s::INTEGER AS nb, t.s::INTEGER AS nc, round(x + p.s * a, 6) AS x, round(y + q.s * b, 6) AS y, round(z + t.s * c, 6) AS z
FROM cells, s2 p, s3 q, s2 t""")
def supercell(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = supplier_cells(spark, sf_dir)
    out = generators.supercell(cells.drop("lattice"), cells, (2, 3, 2))
    return out.select("struct_id", "na", "nb", "nc", *(F.round(c, 6).alias(c) for c in "xyz"))


@query(f"""WITH {SQL_CELLS}, steps AS (SELECT unnest(range(-3, 4)) AS s)
SELECT struct_id, count(*) AS n FROM cells, steps p, steps q, steps t WHERE sqrt(p.s*p.s*a*a + q.s*q.s*b*b + t.s*t.s*c*c) <= 9.9 GROUP BY struct_id""")
def supercell_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = supplier_cells(spark, sf_dir)
    return generators.sphere(cells.drop("lattice"), cells, 9.9, correction=False).groupBy("struct_id").agg(F.count("*").alias("n"))


@query(f"""WITH {SQL_CELLS} SELECT struct_id, count(*) AS n, round(max(i / (a / 0.7) * a), 6) AS last_x
FROM (SELECT *, unnest(range(0, ceil(a / 0.7)::BIGINT)) AS i FROM cells), LATERAL (SELECT unnest(range(0, ceil(b / 0.7)::BIGINT)) AS j), LATERAL (SELECT unnest(range(0, ceil(c / 0.7)::BIGINT)) AS k)
GROUP BY struct_id""")
def grid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = generators.grid_points(supplier_cells(spark, sf_dir), 0.7)
    return points.groupBy("struct_id").agg(F.count("*").alias("n"), F.round(F.max("x"), 6).alias("last_x"))


SQL_PACKING = f"""WITH {SQL_CELLS}, i3 AS (SELECT unnest([-1, 0, 1]) AS s),
points AS (
  SELECT cells.*, i / (a / 0.7) * a AS px, j / (b / 0.7) * b AS py, k / (c / 0.7) * c AS pz
  FROM cells, LATERAL (SELECT unnest(range(0, ceil(a / 0.7)::BIGINT)) AS i), LATERAL (SELECT unnest(range(0, ceil(b / 0.7)::BIGINT)) AS j),
       LATERAL (SELECT unnest(range(0, ceil(c / 0.7)::BIGINT)) AS k)),
tested AS (
  SELECT struct_id, px, py, pz, r, min(sqrt(pow(px - (x - floor(x / a) * a) - p.s * a, 2) + pow(py - (y - floor(y / b) * b) - q.s * b, 2) + pow(pz - (z - floor(z / c) * c) - t.s * c, 2))) AS d
  FROM points, i3 p, i3 q, i3 t GROUP BY ALL)
SELECT struct_id, count(*) AS points, count(*) FILTER (d < r) AS occupied, (count(*) FILTER (d < r))::DOUBLE / count(*) AS packing_factor FROM tested GROUP BY struct_id"""


@query(SQL_PACKING)
def packing_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = supplier_cells(spark, sf_dir)
    return generators.packing(cells.drop("lattice"), cells, 0.7)


@query(SQL_PACKING)
def packing_share_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = supplier_cells(spark, sf_dir)
    return local.packing(structures.to_structures(cells, cells.select("struct_id", "lattice")), 0.7)


@query()
def best_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = structures.to_atoms(supplier_molecules(spark, sf_dir))
    return generators.best_view(generators.projected_areas(atoms, 30)).select("struct_id", F.round("area", 6).alias("area"))


# Numerics on molecules and crystals

SQL_MOLECULES = "molecules AS (SELECT format('s{:08d}', s_suppkey) AS struct_id, (s_suppkey % 5)::INTEGER AS k FROM supplier)"


def against_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each molecule with the first of its formula."""
    rows = supplier_molecules(spark, sf_dir)
    key = F.array_join(F.array_sort("elements"), "")
    firsts = rows.groupBy(key.alias("formula")).agg(F.min("struct_id").alias("id1"))
    met = rows.select(key.alias("formula"), F.col("struct_id").alias("id2")).join(firsts, "formula").where("id1 <> id2")
    return local.paired(met.select("id1", "id2"), rows)


@query(f"""WITH {SQL_MOLECULES}, firsts AS (SELECT k, min(struct_id) AS id1 FROM molecules GROUP BY k)
SELECT id1, struct_id AS id2, true AS is_match, 0.0::DOUBLE AS rmsd FROM molecules JOIN firsts USING (k) WHERE struct_id <> id1""")
def compare_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies that are turned and moved match the first of their formula with no displacement."""
    found = local.compared(against_first(spark, sf_dir))
    return found.select("id1", "id2", "is_match", F.abs(F.round("rmsd", 6)).alias("rmsd"))


@query()
def rmsd_to_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return local.displacements(against_first(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(f"""WITH {SQL_MOLECULES}
SELECT struct_id, unnest(([['H', 'H', 'O'], ['H', 'H', 'H', 'N'], ['H', 'H', 'C', 'O'], ['H', 'C', 'N'], ['C', 'H', 'H', 'H', 'H', 'O']])[k + 1]) AS element FROM molecules""")
def canonical_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of each molecule after canonical ordering, which loses none."""
    return local.canonical(supplier_molecules(spark, sf_dir)).select("struct_id", F.explode("elements").alias("element"))


@query(f"""WITH {SQL_MOLECULES} SELECT struct_id, ([2, 6, 2, 1, 6])[k + 1]::BIGINT AS n FROM molecules""")
def symmetric_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many atom orders a molecule's graph leaves alike: permutations of its equal hydrogens."""
    return local.symmetric_orders(supplier_molecules(spark, sf_dir)).groupBy("struct_id").agg(F.count("*").alias("n"))


@query(f"""WITH {SQL_MOLECULES} SELECT struct_id, 0::INTEGER AS mol_idx, ([3, 4, 4, 3, 6])[k + 1]::INTEGER AS n FROM molecules""")
def molecules_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return local.molecules_local(supplier_molecules(spark, sf_dir)).select("struct_id", "mol_idx", F.size("atoms").alias("n"))


@query(f"WITH {SQL_MOLECULES} SELECT struct_id, 1.0::DOUBLE AS determinant FROM molecules")
def principal_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes are right-handed and of unit volume."""
    rows = local.principal_axes(supplier_molecules(spark, sf_dir))
    return rows.select("struct_id", F.round(G.volume(G.lattice_columns("axes")), 6).alias("determinant"))


@query()
def molecule_symmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return local.symmetry(supplier_molecules(spark, sf_dir), 4, 0.3).groupBy("struct_id").agg(F.count("*").alias("n"))


@query(f"""WITH {SQL_MOLECULES} SELECT struct_id, 2::INTEGER AS n_molecules, 2 * ([3, 4, 4, 3, 6])[k + 1]::INTEGER AS n_atoms FROM molecules""")
def standardized_crystals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules are whole after standardising, two to a cell, and no atom is lost."""
    rows = local.standardized(supplier_crystals(spark, sf_dir))
    return rows.select("struct_id", F.size("molecules").alias("n_molecules"), F.size("elements").alias("n_atoms"))


@query(f"WITH {SQL_MOLECULES} SELECT struct_id, 'sheet' AS motif FROM molecules")
def crystal_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules that all point one way are a sheet."""
    return local.motifs(supplier_crystals(spark, sf_dir), nn=12).select("struct_id", "motif")


@query(f"WITH {SQL_MOLECULES} SELECT struct_id, 0.0::DOUBLE AS value FROM molecules")
def crystal_rmsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crystal against itself with its origin moved."""
    rows = supplier_crystals(spark, sf_dir)
    moved = F.transform("geometry", lambda p: F.array(p[0] + 1.3, p[1] - 0.7, p[2] + 2.9))
    both = rows.select(F.col("struct_id").alias("id1"), F.col("struct_id").alias("id2"), *(F.col(c).alias(f"{c}1") for c in ("elements", "geometry", "lattice")), F.col("elements").alias("elements2"), moved.alias("geometry2"), F.col("lattice").alias("lattice2"))
    return local.crystal_rmsds(both, nn=8, hydrogens=True).select(F.col("id1").alias("struct_id"), F.abs(F.round("value", 6)).alias("value"))


# Restart and streams


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def restart_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.remaining(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), key="doc_id")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, sum(value::DECIMAL(18,6))::DOUBLE AS total FROM events GROUP BY ALL""")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.windowed_counts(table(spark, sf_dir, "events"))


@query("""SELECT c_custkey AS key FROM customer UNION SELECT s_suppkey FROM supplier EXCEPT SELECT p_partkey FROM part WHERE p_size > 25""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda name, c: table(spark, sf_dir, name).select(F.col(c).alias("key"))
    both = key("customer", "c_custkey").union(key("supplier", "s_suppkey")).distinct()
    return both.subtract(table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("key")))
