"""Element data and the radii derived from it, as a small dimension table and as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Symbol, atomic number, standard mass (IUPAC 2016; the longest-lived isotope's where there is none), covalent
#: radius (Cordero 2008), van der Waals radius (Bondi 1964 and later), van der Waals radius (Alvarez 2013); None where no value
#: is published.
ELEMENTS = (
    ("H", 1, 1.008, 0.31, 1.20, 1.20),
    ("He", 2, 4.002602, 0.28, 1.40, 1.43),
    ("Li", 3, 6.94, 1.28, 1.82, 2.12),
    ("Be", 4, 9.0121831, 0.96, 1.53, 1.98),
    ("B", 5, 10.81, 0.84, 1.92, 1.91),
    ("C", 6, 12.011, 0.76, 1.70, 1.77),
    ("N", 7, 14.007, 0.71, 1.55, 1.66),
    ("O", 8, 15.999, 0.66, 1.52, 1.50),
    ("F", 9, 18.998403163, 0.57, 1.47, 1.46),
    ("Ne", 10, 20.1797, 0.58, 1.54, 1.58),
    ("Na", 11, 22.98976928, 1.66, 2.27, 2.50),
    ("Mg", 12, 24.305, 1.41, 1.73, 2.51),
    ("Al", 13, 26.9815385, 1.21, 1.84, 2.25),
    ("Si", 14, 28.085, 1.11, 2.10, 2.19),
    ("P", 15, 30.973761998, 1.07, 1.80, 1.90),
    ("S", 16, 32.06, 1.05, 1.80, 1.89),
    ("Cl", 17, 35.45, 1.02, 1.75, 1.82),
    ("Ar", 18, 39.948, 1.06, 1.88, 1.83),
    ("K", 19, 39.0983, 2.03, 2.75, 2.73),
    ("Ca", 20, 40.078, 1.76, 2.31, 2.62),
    ("Sc", 21, 44.955908, 1.70, None, 2.58),
    ("Ti", 22, 47.867, 1.60, None, 2.46),
    ("V", 23, 50.9415, 1.53, None, 2.42),
    ("Cr", 24, 51.9961, 1.39, None, 2.45),
    ("Mn", 25, 54.938044, 1.39, None, 2.45),
    ("Fe", 26, 55.845, 1.32, None, 2.44),
    ("Co", 27, 58.933194, 1.26, None, 2.40),
    ("Ni", 28, 58.6934, 1.24, 1.63, 2.40),
    ("Cu", 29, 63.546, 1.32, 1.40, 2.38),
    ("Zn", 30, 65.38, 1.22, 1.39, 2.39),
    ("Ga", 31, 69.723, 1.22, 1.87, 2.32),
    ("Ge", 32, 72.630, 1.20, 2.11, 2.29),
    ("As", 33, 74.921595, 1.19, 1.85, 1.88),
    ("Se", 34, 78.971, 1.20, 1.90, 1.82),
    ("Br", 35, 79.904, 1.20, 1.85, 1.86),
    ("Kr", 36, 83.798, 1.16, 2.02, 2.25),
    ("Rb", 37, 85.4678, 2.20, 3.03, 3.21),
    ("Sr", 38, 87.62, 1.95, 2.49, 2.84),
    ("Y", 39, 88.90584, 1.90, None, 2.75),
    ("Zr", 40, 91.224, 1.75, None, 2.52),
    ("Nb", 41, 92.90637, 1.64, None, 2.56),
    ("Mo", 42, 95.95, 1.54, None, 2.45),
    ("Tc", 43, 97.90721, 1.47, None, 2.44),
    ("Ru", 44, 101.07, 1.46, None, 2.46),
    ("Rh", 45, 102.90550, 1.42, None, 2.44),
    ("Pd", 46, 106.42, 1.39, 1.63, 2.15),
    ("Ag", 47, 107.8682, 1.45, 1.72, 2.53),
    ("Cd", 48, 112.414, 1.44, 1.58, 2.49),
    ("In", 49, 114.818, 1.42, 1.93, 2.43),
    ("Sn", 50, 118.710, 1.39, 2.17, 2.42),
    ("Sb", 51, 121.760, 1.39, 2.06, 2.47),
    ("Te", 52, 127.60, 1.38, 2.06, 1.99),
    ("I", 53, 126.90447, 1.39, 1.98, 2.04),
    ("Xe", 54, 131.293, 1.40, 2.16, 2.06),
    ("Cs", 55, 132.90545196, 2.44, 3.43, 3.48),
    ("Ba", 56, 137.327, 2.15, 2.68, 3.03),
    ("La", 57, 138.90547, 2.07, None, 2.98),
    ("Ce", 58, 140.116, 2.04, None, 2.88),
    ("Pr", 59, 140.90766, 2.03, None, 2.92),
    ("Nd", 60, 144.242, 2.01, None, 2.95),
    ("Pm", 61, 144.91276, 1.99, None, None),
    ("Sm", 62, 150.36, 1.98, None, 2.90),
    ("Eu", 63, 151.964, 1.98, None, 2.87),
    ("Gd", 64, 157.25, 1.96, None, 2.83),
    ("Tb", 65, 158.92535, 1.94, None, 2.79),
    ("Dy", 66, 162.500, 1.92, None, 2.87),
    ("Ho", 67, 164.93033, 1.92, None, 2.81),
    ("Er", 68, 167.259, 1.89, None, 2.83),
    ("Tm", 69, 168.93422, 1.90, None, 2.79),
    ("Yb", 70, 173.054, 1.87, None, 2.80),
    ("Lu", 71, 174.9668, 1.87, None, 2.74),
    ("Hf", 72, 178.49, 1.75, None, 2.63),
    ("Ta", 73, 180.94788, 1.70, None, 2.53),
    ("W", 74, 183.84, 1.62, None, 2.57),
    ("Re", 75, 186.207, 1.51, None, 2.49),
    ("Os", 76, 190.23, 1.44, None, 2.48),
    ("Ir", 77, 192.217, 1.41, None, 2.41),
    ("Pt", 78, 195.084, 1.36, 1.75, 2.29),
    ("Au", 79, 196.966569, 1.36, 1.66, 2.32),
    ("Hg", 80, 200.592, 1.32, 1.55, 2.45),
    ("Tl", 81, 204.38, 1.45, 1.96, 2.47),
    ("Pb", 82, 207.2, 1.46, 2.02, 2.60),
    ("Bi", 83, 208.98040, 1.48, 2.07, 2.54),
    ("Po", 84, 208.98243, 1.40, 1.97, None),
    ("At", 85, 209.98715, 1.50, 2.02, None),
    ("Rn", 86, 222.01758, 1.50, 2.20, None),
    ("Fr", 87, 223.01974, 2.60, 3.48, None),
    ("Ra", 88, 226.02541, 2.21, 2.83, None),
    ("Ac", 89, 227.02775, 2.15, None, 2.80),
    ("Th", 90, 232.0377, 2.06, None, 2.93),
    ("Pa", 91, 231.03588, 2.00, None, 2.88),
    ("U", 92, 238.02891, 1.96, 1.86, 2.71),
    ("Np", 93, 237.04817, 1.90, None, 2.82),
    ("Pu", 94, 244.06421, 1.87, None, 2.81),
    ("Am", 95, 243.06138, 1.80, None, 2.83),
    ("Cm", 96, 247.07035, 1.69, None, 3.05),
)
#: Grams per cubic centimetre in one atomic mass unit per cubic Angstrom.
DENSITY_UNIT = 1.66053907
#: Contact radius of hydrogen, which suits hydrogen-bonded crystals better than the tabled one.
HYDROGEN_CONTACT = 1.1
#: What a missing van der Waals radius exceeds the covalent one by.
MISSING_VDW = 0.8

NUMBERS = {s: z for s, z, *_ in ELEMENTS}


def contact_radius(symbol: str) -> float:
    """The smaller of both van der Waals radii; the covalent one plus MISSING_VDW where none is tabled."""
    if symbol == "H":
        return HYDROGEN_CONTACT
    _, _, _, cov, vdw, alvarez = next(e for e in ELEMENTS if e[0] == symbol)
    if vdw is None:
        return cov + MISSING_VDW
    return vdw if alvarez is None else min(vdw, alvarez)




class Known(dict):
    """Values by symbol; NaN for a symbol that is none, so that one odd structure gives odd values and doesn't end a job."""

    def __missing__(self, key: str) -> float:
        return float("nan")


MASSES = Known({s: m for s, _, m, *_ in ELEMENTS})
COVALENT = Known({s: r for s, _, _, r, *_ in ELEMENTS})
CONTACT = Known({s: contact_radius(s) for s, *_ in ELEMENTS})
VDW = {s: v if v is not None else c + MISSING_VDW for s, _, _, c, v, _ in ELEMENTS}


def lookup(values: dict, key: Column) -> Column:
    """A value by element symbol as a literal map: one probe a row, nothing joined; unknown symbols give null."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*pairs)[key]


def mass(element: Column) -> Column:
    return lookup(MASSES, element)


def number(element: Column) -> Column:
    return lookup(NUMBERS, element)


def covalent(element: Column) -> Column:
    return lookup(COVALENT, element)


def contact(element: Column) -> Column:
    return lookup(CONTACT, element)


def vdw(element: Column) -> Column:
    return lookup(VDW, element)


def symbol(element: Column) -> Column:
    """A symbol in its usual case, from any case or from an atomic number as text."""
    by_number = lookup({str(z): s for s, z in NUMBERS.items()}, element)
    return F.coalesce(by_number, F.initcap(F.trim(element)))


def elements_table(spark: SparkSession) -> DataFrame:
    """symbol, z, mass, r_cov, r_vdw, r_vdw_alvarez, r_contact: one row an element, small by construction."""
    rows = [(*e, CONTACT[e[0]]) for e in ELEMENTS]
    return spark.createDataFrame(rows, "symbol string, z int, mass double, r_cov double, r_vdw double, r_vdw_alvarez double, r_contact double")
