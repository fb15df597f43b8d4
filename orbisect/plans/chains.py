"""Queries over made-up crystals: each supplier is one, with two chains of atoms that run through the faces of its cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import elements as E
from ..operators import crystals, dedup, generators, graph, networks, pairs, properties
from ..session import table, workspace
from ..streaming.buckets import BucketTable
from . import table_functions
from .catalogue import query

SYMBOLS = ("C", "N", "O")


def chain_crystals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Atoms and lattices. A chain of 2 to 7 atoms, 1.3 apart along x, y, z or the diagonal, and one of two atoms beside it,
    in a cell whose b leans towards a."""
    s = F.col("s_suppkey")
    suppliers = table(spark, sf_dir, "supplier").select(s)
    edge = lambda base, m: (base + s % m).cast("double")
    lean, zero = (s % 3).cast("double") * 0.6, F.lit(0.0)
    lattice = F.array(F.array(edge(4, 3), zero, zero), F.array(lean, edge(5, 2), zero), F.array(zero, zero, edge(4, 5)))
    lattices = suppliers.select(s.cast("string").alias("struct_id"), lattice.alias("lattice"))
    along = [F.when(s % 4 == k, 1.3).when(s % 4 == 3, 0.75).otherwise(0.0) for k in range(3)]
    n = 2 + s % 6
    rows = suppliers.select(s, F.explode(F.sequence(F.lit(0), n + 1)).alias("k"))
    second = F.col("k") >= n
    place = F.when(second, F.col("k") - n).otherwise(F.col("k")).cast("double")
    start = [(s % m).cast("double") * f + 0.0137 for m, f in ((7, 0.31), (11, 0.29), (13, 0.23))]
    beside = [F.when(second, v).otherwise(0.0) for v in (1.71, 1.93, 2.31)]
    xyz = [(a + place * d + b).alias(c) for a, d, b, c in zip(start, along, beside, "xyz", strict=True)]
    symbol = F.get(F.array(*(F.lit(x) for x in SYMBOLS)), ((F.col("k") + s) % 3).cast("int"))
    atoms = rows.select(s.cast("string").alias("struct_id"), F.col("k").cast("int").alias("atom_idx"), symbol.alias("element"), *xyz)
    return atoms, lattices


SQL_CHAINS = """
cells AS (SELECT s_suppkey::VARCHAR AS struct_id, s_suppkey AS s, (4 + s_suppkey % 3)::DOUBLE AS la, (s_suppkey % 3)::DOUBLE * 0.6 AS lean, (5 + s_suppkey % 2)::DOUBLE AS lb, (4 + s_suppkey % 5)::DOUBLE AS lc, 2 + s_suppkey % 6 AS n FROM supplier),
numbered AS (SELECT *, unnest(range(0, n + 2)) AS k FROM cells),
atoms AS (
  SELECT struct_id, k::INTEGER AS atom_idx, (['C', 'N', 'O'])[(k + s) % 3 + 1] AS element, la, lean, lb, lc,
         (s % 7)::DOUBLE * 0.31 + 0.0137 + p * (CASE WHEN s % 4 = 0 THEN 1.3 WHEN s % 4 = 3 THEN 0.75 ELSE 0 END)::DOUBLE + (CASE WHEN k >= n THEN 1.71 ELSE 0 END)::DOUBLE AS x,
         (s % 11)::DOUBLE * 0.29 + 0.0137 + p * (CASE WHEN s % 4 = 1 THEN 1.3 WHEN s % 4 = 3 THEN 0.75 ELSE 0 END)::DOUBLE + (CASE WHEN k >= n THEN 1.93 ELSE 0 END)::DOUBLE AS y,
         (s % 13)::DOUBLE * 0.23 + 0.0137 + p * (CASE WHEN s % 4 = 2 THEN 1.3 WHEN s % 4 = 3 THEN 0.75 ELSE 0 END)::DOUBLE + (CASE WHEN k >= n THEN 2.31 ELSE 0 END)::DOUBLE AS z
  FROM (SELECT *, (CASE WHEN k >= n THEN k - n ELSE k END)::DOUBLE AS p FROM numbered)),
fractions AS (SELECT *, (x - lean * y / lb) / la AS fa, y / lb AS fb, z / lc AS fc FROM atoms),
home AS (SELECT *, fa - floor(fa) AS ga, fb - floor(fb) AS gb, fc - floor(fc) AS gc FROM fractions),
put AS (SELECT *, ga * la + gb * lean AS hx, gb * lb AS hy, gc * lc AS hz FROM home),
radii(element, cov, vdw) AS (VALUES """ + ", ".join(f"('{s}', {E.COVALENT[s]!r}::DOUBLE, {E.VDW[s]!r}::DOUBLE)" for s in SYMBOLS) + """),
steps AS (SELECT unnest(range(-REACH, REACH + 1)) AS n),
images AS (
  SELECT p.struct_id, p.atom_idx AS j, p.element, na.n AS na, nb.n AS nb, nc.n AS nc, hx + na.n * la + nb.n * lean AS ix, hy + nb.n * lb AS iy, hz + nc.n * lc AS iz
  FROM put p, steps na, steps nb, steps nc),
near AS (
  SELECT p.struct_id, p.atom_idx AS i, m.j, m.na, m.nb, m.nc, r.cov + s.cov AS cov, r.vdw + s.vdw AS vdw, sqrt((hx - ix) * (hx - ix) + (hy - iy) * (hy - iy) + (hz - iz) * (hz - iz)) AS d
  FROM put p JOIN images m ON p.struct_id = m.struct_id AND NOT (p.atom_idx = m.j AND m.na = 0 AND m.nb = 0 AND m.nc = 0)
  JOIN radii r ON r.element = p.element JOIN radii s ON s.element = m.element),
bonds AS (SELECT struct_id, i, j, na, nb, nc FROM near WHERE d < 1.2 * cov)"""

#: Components without cells first, then walks from each root over cells up to three away.
SQL_WHOLE = """
reach AS (SELECT struct_id, atom_idx AS i, atom_idx AS j FROM atoms UNION SELECT reach.struct_id, reach.i, bonds.j FROM reach JOIN bonds ON reach.struct_id = bonds.struct_id AND reach.j = bonds.i),
roots AS (SELECT struct_id, i AS atom_idx, min(j) AS root FROM reach GROUP BY ALL),
walk AS (
  SELECT struct_id, root, root AS atom_idx, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c FROM roots WHERE root = atom_idx
  UNION SELECT w.struct_id, w.root, b.j, w.a + b.na, w.b + b.nb, w.c + b.nc FROM walk w JOIN bonds b ON w.struct_id = b.struct_id AND w.atom_idx = b.i
  WHERE abs(w.a + b.na) <= 3 AND abs(w.b + b.nb) <= 3 AND abs(w.c + b.nc) <= 3),
loops AS (SELECT struct_id, root, sum(a * a) AS aa, sum(b * b) AS bb, sum(c * c) AS cc, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * c) AS bc FROM walk WHERE atom_idx = root GROUP BY ALL),
endless AS (
  SELECT struct_id, root, CASE WHEN aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) <> 0 THEN 3
         WHEN aa * bb - ab * ab + aa * cc - ac * ac + bb * cc - bc * bc <> 0 THEN 2 WHEN aa + bb + cc <> 0 THEN 1 ELSE 0 END AS periodicity FROM loops),
mols AS (
  SELECT r.struct_id, r.atom_idx, (dense_rank() OVER (PARTITION BY r.struct_id ORDER BY r.root) - 1)::INTEGER AS mol_idx, periodicity,
         CASE WHEN periodicity > 0 THEN 0 ELSE a END AS sa, CASE WHEN periodicity > 0 THEN 0 ELSE b END AS sb, CASE WHEN periodicity > 0 THEN 0 ELSE c END AS sc
  FROM roots r JOIN endless e ON r.struct_id = e.struct_id AND r.root = e.root
  JOIN (SELECT struct_id, atom_idx, min(a) AS a, min(b) AS b, min(c) AS c FROM walk GROUP BY ALL) w ON w.struct_id = r.struct_id AND w.atom_idx = r.atom_idx)"""


def chains(reach: int) -> str:
    return SQL_CHAINS.replace("REACH", str(reach))


@query(f"""WITH RECURSIVE {chains(1)}, {SQL_WHOLE}
SELECT struct_id, atom_idx, mol_idx, sa::INTEGER AS sa, sb::INTEGER AS sb, sc::INTEGER AS sc, periodicity::INTEGER AS periodicity FROM mols""")
def molecule_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules cut by cell faces, the cells that make them whole, and chains that have no end."""
    atoms, lattices = chain_crystals(spark, sf_dir)
    return networks.molecules(atoms, pairs.periodic_bonds(atoms, lattices, 1.2))


@query(f"""WITH RECURSIVE {chains(1)}, {SQL_WHOLE},
masses(element, mass) AS (VALUES {", ".join(f"('{s}', {E.MASSES[s]!r}::DOUBLE)" for s in SYMBOLS)}),
placed AS (
  SELECT p.struct_id, p.atom_idx, mol_idx, la, lean, lb, lc, mass, hx + sa * la + sb * lean AS x, hy + sb * lb AS y, hz + sc * lc AS z
  FROM put p JOIN mols m ON p.struct_id = m.struct_id AND p.atom_idx = m.atom_idx JOIN masses e ON e.element = p.element),
centres AS (SELECT struct_id, mol_idx, sum(mass * x) / sum(mass) AS cx, sum(mass * y) / sum(mass) AS cy, sum(mass * z) / sum(mass) AS cz FROM placed GROUP BY ALL),
cells_out AS (
  SELECT p.*, floor((cx - lean * cy / lb) / la + 1e-9::DOUBLE) AS oa, floor(cy / lb + 1e-9::DOUBLE) AS ob, floor(cz / lc + 1e-9::DOUBLE) AS oc
  FROM placed p JOIN centres c ON p.struct_id = c.struct_id AND p.mol_idx = c.mol_idx)
SELECT struct_id, atom_idx, round(x - oa * la - ob * lean, 6) + 0.0 AS x, round(y - ob * lb, 6) + 0.0 AS y, round(z - oc * lc, 6) + 0.0 AS z FROM cells_out""")
def whole_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules cut by cell faces in one piece, each with its centre of mass in the cell."""
    atoms, lattices = chain_crystals(spark, sf_dir)
    found = networks.molecules(atoms, pairs.periodic_bonds(atoms, lattices, 1.2))
    return networks.whole(atoms, lattices, found).select("struct_id", "atom_idx", *((F.round(c, 6) + 0.0).alias(c) for c in "xyz"))


@query(f"""WITH RECURSIVE {chains(3)}, {SQL_WHOLE}
SELECT n.struct_id, n.i, n.j, n.na::INTEGER AS na, n.nb::INTEGER AS nb, n.nc::INTEGER AS nc, round(d / vdw, 9) AS ratio, a.mol_idx AS mol_idx1, b.mol_idx AS mol_idx2
FROM near n JOIN mols a ON n.struct_id = a.struct_id AND n.i = a.atom_idx JOIN mols b ON n.struct_id = b.struct_id AND n.j = b.atom_idx
WHERE d / vdw < 1.1 AND (a.mol_idx <> b.mol_idx OR a.periodicity = 0 AND (n.na - b.sa + a.sa <> 0 OR n.nb - b.sb + a.sb <> 0 OR n.nc - b.sc + a.sc <> 0))""")
def periodic_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts between molecules and their copies in other cells, with the cells that whole molecules take atoms from."""
    atoms, lattices = chain_crystals(spark, sf_dir)
    found = networks.molecules(atoms, pairs.periodic_bonds(atoms, lattices, 1.2))
    near = pairs.periodic_neighbours(atoms, lattices, 1.1 * 2 * max(E.VDW[s] for s in SYMBOLS), 1.1 * 2 * max(E.VDW[s] for s in SYMBOLS))
    met = pairs.contacts(near, found, 1.1)
    return met.select("struct_id", "i", "j", *(F.col(c).cast("int").alias(c) for c in ("na", "nb", "nc")), F.round("ratio", 9).alias("ratio"), "mol_idx1", "mol_idx2")


def box_crystals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier is a crystal of one water molecule in a box, ten boxes in all, written in one of six ways by its key: as it
    is, strained, with its edges permuted, doubled, with a skew cell, or with its origin moved."""
    s = F.col("s_suppkey")
    box = (s % 10).cast("double")
    rows = table(spark, sf_dir, "supplier").select(
        s.alias("s"), F.floor(s / 10 % 6).cast("int").alias("way"), (4.5 + box * 0.11).alias("a"), (5.2 + (box % 5) * 0.37).alias("b"), (6.1 + (box % 3) * 0.53).alias("c")
    )
    stretch = F.when(F.col("way") == 1, 1.01).otherwise(1.0)
    edges = [F.col("a") * stretch, F.col("b"), F.col("c")]
    order = [F.when(F.col("way") == 2, edges[(k + 1) % 3]).otherwise(edges[k]) for k in range(3)]
    zero, way = F.lit(0.0), lambda k: F.col("way") == k
    lattice = F.array(
        F.array(order[0] * F.when(way(3), 2.0).otherwise(1.0), zero, zero), F.array(F.when(way(4), 2 * order[0]).otherwise(0.0), order[1], zero),
        F.array(F.when(way(4), -order[0]).otherwise(0.0), F.when(way(4), order[1]).otherwise(0.0), order[2]),
    )
    water = [("O", 0.0, 0.0, 0.0), ("H", 0.757, 0.586, 0.1), ("H", -0.757, 0.586, 0.2)]
    shift = F.when(way(5), 3.3).otherwise(0.4)
    # Permuted edges take the molecule's axes with them.
    turned = lambda p: [F.when(way(2), p[(k + 1) % 3]).otherwise(p[k]) + shift for k in range(3)]
    one = F.array(*(F.array(*turned(p[1:])) for p in water))
    again = F.array(*(F.array(turned(p[1:])[0] + F.col("a"), *turned(p[1:])[1:]) for p in water))
    symbols = F.array(*(F.lit(p[0]) for p in water))
    double = lambda x, y: F.when(way(3), F.concat(x, y)).otherwise(x)
    return rows.select(
        F.format_string("s%08d", "s").alias("struct_id"), double(symbols, symbols).alias("elements"), double(one, again).alias("geometry"), lattice.alias("lattice"),
        F.create_map().cast("map<string,string>").alias("properties"),
    )


#: The lattice measures of boxes are their edges; all pairs are compared.
SQL_BOXES = """
boxes AS (
  SELECT printf('s%08d', s_suppkey) AS id, list_sort([(4.5 + (s_suppkey % 10)::DOUBLE * 0.11) * (CASE WHEN s_suppkey // 10 % 6 = 1 THEN 1.01 ELSE 1.0 END), 5.2 + (s_suppkey % 10 % 5)::DOUBLE * 0.37, 6.1 + (s_suppkey % 10 % 3)::DOUBLE * 0.53]) AS e,
         s_suppkey % 10 AS box
  FROM supplier),
compared AS (
  SELECT a.id AS id1, b.id AS id2, a.box = b.box AS same, list_max(list_transform(list_zip(a.e, b.e), lambda p: greatest(p[1] / p[2], p[2] / p[1]))) - 1 AS off
  FROM boxes a JOIN boxes b ON a.id < b.id)"""


@query(f"WITH {SQL_BOXES} SELECT id1, id2, round(off, 6) + 0.0 AS value FROM compared WHERE off <= 0.025")
def lattice_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of lattices within a strain, whatever cells they are written in."""
    found = crystals.duplicates(box_crystals(spark, sf_dir), strain=0.025, rmsd=None)
    return found.select("id1", "id2", (F.round("value", 6) + 0.0).alias("value"))


@query(f"WITH {SQL_BOXES} SELECT id1, id2 FROM compared WHERE same")
def duplicate_crystals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crystals that are one and the same but for a strain of 1 %, their cell and their origin."""
    found = crystals.duplicates(box_crystals(spark, sf_dir), strain=0.03, rmsd=0.1)
    return found.where("is_match").select("id1", "id2")


def molecule_centres(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The middle of each molecule of chain_crystals(), and the lattices."""
    atoms, lattices = chain_crystals(spark, sf_dir)
    found = networks.molecules(atoms, pairs.periodic_bonds(atoms, lattices, 1.2))
    put = networks.whole(atoms, lattices, found).join(found.select("struct_id", "atom_idx", "mol_idx"), ["struct_id", "atom_idx"])
    return put.groupBy("struct_id", F.col("mol_idx").alias("atom_idx")).agg(*(F.avg(c).alias(c) for c in "xyz")), lattices


@query(f"""WITH RECURSIVE {chains(1)}, {SQL_WHOLE},
centres AS (
  SELECT p.struct_id, mol_idx, any_value(la) AS la, any_value(lean) AS lean, any_value(lb) AS lb, any_value(lc) AS lc, avg(hx + sa * la + sb * lean) AS x, avg(hy + sb * lb) AS y, avg(hz + sc * lc) AS z
  FROM put p JOIN mols m ON p.struct_id = m.struct_id AND p.atom_idx = m.atom_idx GROUP BY ALL),
far AS (SELECT unnest(range(-7, 8)) AS n),
others AS (SELECT struct_id, mol_idx, x + na.n * la + nb.n * lean AS x, y + nb.n * lb AS y, z + nc.n * lc AS z, na.n = 0 AND nb.n = 0 AND nc.n = 0 AS home FROM centres, far na, far nb, far nc),
ranked AS (
  SELECT c.struct_id, c.mol_idx AS i, sqrt((c.x - o.x) * (c.x - o.x) + (c.y - o.y) * (c.y - o.y) + (c.z - o.z) * (c.z - o.z)) AS d,
         row_number() OVER (PARTITION BY c.struct_id, c.mol_idx ORDER BY (c.x - o.x) * (c.x - o.x) + (c.y - o.y) * (c.y - o.y) + (c.z - o.z) * (c.z - o.z)) AS rank
  FROM centres c JOIN others o ON c.struct_id = o.struct_id AND NOT (o.home AND c.mol_idx = o.mol_idx))
SELECT struct_id, i, rank::INTEGER AS rank, round(d, 6) AS d FROM ranked WHERE rank <= 14""")
def nearest_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 14 nearest molecules of each, found with a radius that grows where it is too small."""
    centres, lattices = molecule_centres(spark, sf_dir)
    return pairs.periodic_nearest(centres, lattices, 14).select("struct_id", "i", "rank", F.round("d", 6).alias("d"))


def sql_colours(rounds: int = 10) -> str:
    """Rounds of refinement over all structures at once, each colour the rank of what it is made from."""
    steps = ["colours0 AS (SELECT struct_id, atom_idx, dense_rank() OVER (ORDER BY element) AS c FROM atoms)"]
    for k in range(rounds):
        steps.append(f"""made{k} AS (
  SELECT a.struct_id, a.atom_idx, any_value(a.c) AS c, coalesce(list(b.c ORDER BY b.c) FILTER (b.c IS NOT NULL), []) AS near
  FROM colours{k} a LEFT JOIN links l ON l.struct_id = a.struct_id AND l.i = a.atom_idx LEFT JOIN colours{k} b ON b.struct_id = a.struct_id AND b.atom_idx = l.j GROUP BY a.struct_id, a.atom_idx),
colours{k + 1} AS MATERIALIZED (SELECT struct_id, atom_idx, dense_rank() OVER (ORDER BY c, near) AS c FROM made{k})""")
    return ",\n".join([f"{chains(1)}, links AS (SELECT DISTINCT struct_id, i, j FROM bonds)", *steps, f"told AS (SELECT * FROM colours{rounds})"])


def coloured(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms, lattices = chain_crystals(spark, sf_dir)
    return graph.refined(atoms, pairs.periodic_bonds(atoms, lattices, 1.2))


@query(f"WITH {sql_colours()} SELECT struct_id, atom_idx, (min(atom_idx) OVER (PARTITION BY struct_id, c))::INTEGER AS first FROM told")
def refined_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms of one kind, as the first of their kind in each structure."""
    first = F.min("atom_idx").over(Window.partitionBy("struct_id", "descriptor"))
    return coloured(spark, sf_dir).select("struct_id", "atom_idx", first.alias("first"))


@query(f"""WITH {sql_colours()}, signs AS (SELECT struct_id, list(c ORDER BY c) AS sign FROM told GROUP BY struct_id)
SELECT struct_id, min(struct_id) OVER (PARTITION BY sign) AS first, count(*) OVER (PARTITION BY sign) AS n FROM signs""")
def equal_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structures whose bonds can't be told apart, as the first of each kind."""
    signs = graph.graph_signature(coloured(spark, sf_dir))
    by = Window.partitionBy("signature")
    return signs.select("struct_id", F.min("struct_id").over(by).alias("first"), F.count("*").over(by).alias("n"))


#: A document costs its length, and one of each hundred ten thousand times as much.
COST = "n_chars * (CASE WHEN doc_id % 100 = 0 THEN 10000 ELSE 1 END)"


@query(f"""WITH jobs AS (SELECT doc_id, ({COST})::HUGEINT AS cost, doc_id % 64 AS b, row_number() OVER () AS r FROM documents),
whole AS (SELECT sum(cost) AS total FROM jobs),
large AS (SELECT doc_id, row_number() OVER (ORDER BY cost DESC, doc_id) - 1 AS part, cost FROM jobs, whole WHERE cost * 16 > total),
taken AS (SELECT count(*) AS n, coalesce(sum(cost), 0) AS c FROM large),
rest AS (SELECT doc_id, cost, sum(cost) OVER (ORDER BY b, doc_id, r) - cost AS start FROM jobs, whole WHERE NOT cost * 16 > total)
SELECT doc_id, part::INTEGER AS part FROM large UNION ALL
SELECT doc_id, (least((start * (16 - n)) // (total - c), 15 - n) + n)::INTEGER AS part FROM rest, whole, taken""")
def cost_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 16 bins whose costs are even, though costs differ by a factor of ten thousand."""
    jobs = table(spark, sf_dir, "documents").select("doc_id", F.expr(COST).alias("cost"))
    return dedup.least_loaded(jobs, "cost", 16, "doc_id", block=F.col("doc_id") % 64).select("doc_id", "part")


#: Groups of 1, 2, 4 and 12 rotations: none, about z, about all axes, and those of a tetrahedron.
GROUPS = [[(1.0, 0.0, 0.0, 0.0)]]
GROUPS.append(GROUPS[0] + [(0.0, 0.0, 0.0, 1.0)])
GROUPS.append(GROUPS[1] + [(0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0)])
GROUPS.append(GROUPS[2] + [(0.5, x, y, z) for x in (0.5, -0.5) for y in (0.5, -0.5) for z in (0.5, -0.5)])


@query("""WITH steps AS (SELECT unnest(range(0, 360, 45)) AS t),
grid AS (
  SELECT a.t AS a, b.t AS b, c.t AS c, cos(radians(a.t)) AS ca, sin(radians(a.t)) AS sa, cos(radians(b.t)) AS cb, sin(radians(b.t)) AS sb, cos(radians(c.t)) AS cc, sin(radians(c.t)) AS sc
  FROM steps a, steps b, steps c),
turned AS (
  SELECT a, b, c, [[cc * cb, sc * cb, -sb], [cc * sb * sa - sc * ca, sc * sb * sa + cc * ca, cb * sa], [cc * sb * ca + sc * sa, sc * sb * ca - cc * sa, cb * ca]] AS cols FROM grid),
ops AS (SELECT g, p, x, y, x * y AS z FROM (SELECT unnest(range(0, 4)) AS g), (SELECT unnest(range(0, 3)) AS p), (SELECT unnest([1, -1]) AS x), (SELECT unnest([1, -1]) AS y)
  WHERE (p = 0 OR g = 3) AND (g <> 0 OR x = 1 AND y = 1) AND (g <> 1 OR x = y)),
orbits AS (
  SELECT g, a, b, c, min(list_transform(list_concat(list_transform(cols[p + 1], lambda v: v * x), list_transform(cols[(p + 1) % 3 + 1], lambda v: v * y), list_transform(cols[(p + 2) % 3 + 1], lambda v: v * z)), lambda v: round(v, 4) + 0.0)) AS k
  FROM turned, ops GROUP BY ALL),
firsts AS (SELECT g, min([a, b, c]) AS m FROM orbits GROUP BY g, k)
SELECT s_suppkey::VARCHAR AS struct_id, m[1]::INTEGER AS a, m[2]::INTEGER AS b, m[3]::INTEGER AS c FROM supplier JOIN firsts ON g = s_suppkey % 4""")
def unique_orientations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles of a grid less what each supplier's symmetry makes equal: groups of 1, 2, 4 and 12 rotations, by its key."""
    groups = F.array(*(F.array(*(F.array(*(F.lit(float(x)) for x in q)) for q in g)) for g in GROUPS))
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("struct_id"), F.get(groups, (F.col("s_suppkey") % 4).cast("int")).alias("ops"))
    return generators.unique_angles(own, 45)


@query("""SELECT event_id::VARCHAR AS struct_id, json_extract(props, '$.k')::INTEGER AS k, round(value, 6) + 0.0 AS deep FROM events WHERE json_extract(props, '$.k')::INTEGER > 50""")
def typed_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as documents with open properties: there and back, a filter by a number among them, and a look into a list."""
    rows = table(spark, sf_dir, "events").select(
        F.to_json(F.struct(F.col("event_id").cast("string").alias("struct_id"), F.array(F.lit("C")).alias("elements"), F.struct(F.array(F.struct(F.col("value").alias("b"))).alias("c")).alias("more"))).alias("head"),
        F.concat(F.lit(',"properties":'), "props", F.lit("}")).alias("tail"),
    )
    docs = rows.select(F.concat(F.expr("substring(head, 1, length(head) - 1)"), "tail").alias("doc"))
    there = properties.from_typed_documents(docs)
    back = properties.from_typed_documents(properties.typed_documents(there).select("doc"))
    kept = back.where(properties.value("k", "double") > 50)
    return kept.select("struct_id", properties.value("k", "int").alias("k"), (F.round(properties.value("more", "double", "$.c[0].b"), 6) + 0.0).alias("deep"))


@query("""WITH cells AS (
  SELECT s_suppkey::VARCHAR AS struct_id, 4.5 + (s_suppkey % 10)::DOUBLE * 0.11 AS a, 5.2 + (s_suppkey % 10 % 5)::DOUBLE * 0.37 AS b, s_suppkey % 6 AS n FROM supplier),
atoms AS (SELECT *, unnest(range(0, n + 1)) AS k FROM cells)
SELECT struct_id, k::INTEGER AS src_atom_idx, na::INTEGER AS na, nb::INTEGER AS nb, round(k * 0.5 + na * a, 6) AS x, round(k * 0.25 + nb * b, 6) AS y
FROM atoms, (SELECT unnest(range(0, 2)) AS na), (SELECT unnest(range(0, 3)) AS nb)""")
def sql_supercell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supercells asked for in SQL."""
    table_functions.register(spark)
    s, zero = F.col("s_suppkey"), F.lit(0.0)
    box = (s % 10).cast("double")
    lattice = F.array(F.array(4.5 + box * 0.11, zero, zero), F.array(zero, 5.2 + (box % 5) * 0.37, zero), F.array(zero, zero, F.lit(7.0)))
    k = F.sequence(F.lit(0), (s % 6).cast("int"))
    rows = table(spark, sf_dir, "supplier").select(
        s.cast("string").alias("struct_id"), F.transform(k, lambda _: F.lit("C")).alias("elements"), F.transform(k, lambda i: F.array(i * 0.5, i * 0.25, F.lit(0.0))).alias("geometry"), lattice.alias("lattice"), F.lit("more").alias("x")
    )
    out = spark.sql("SELECT * FROM supercell(TABLE({rows}), 2, 3, 1)", rows=rows)
    return out.select("struct_id", "src_atom_idx", "na", "nb", *(F.round(c, 6).alias(c) for c in "xy"))


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def bucket_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's newest order, kept in a table in buckets that is merged with all orders in three batches."""
    kept = BucketTable(workspace(spark, "buckets"), "o_custkey", 16)
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    for part in (1, 2, 0):
        kept.upsert(orders.where(F.col("o_orderkey") % 3 == part), order="o_orderkey")
    kept.vacuum()
    return kept.read(spark)
