"""Parsers and writers of structure files: text in, rows out, and back. Line ends may be LF, CR or CRLF."""

from __future__ import annotations

import json
import math
import re
from pathlib import PurePosixPath

import numpy as np

from ..functions.elements import NUMBERS

FORMATS = {"json": "json", "cif": "cif", "in": "geometry", "next_step": "geometry", "xyz": "xyz"}
BONDS_KW = {"mult": 1.2, "skin": 0.0, "update": False}


def extension(path: str) -> str:
    """Text after the last dot of the name; a name that only begins with one has none."""
    name = PurePosixPath(path).name
    return name.rpartition(".")[2] if "." in name[1:] else ""


def file_type(path: str) -> str:
    """The format that a file's extension stands for, or an empty string."""
    return FORMATS.get(extension(path).lower(), "")


def checked_format(name: str) -> str:
    if name not in set(FORMATS.values()):
        raise ValueError(f"formats are {sorted(set(FORMATS.values()))}, not {name!r}")
    return name


def with_extension(path: str, ext: str) -> str:
    """path with the extension, in place of a known one."""
    stem = path[: -len(extension(path)) - 1] if extension(path).lower() in FORMATS else path
    return f"{stem}.{ext.lstrip('.')}"


def lines_of(text: str) -> list[str]:
    return re.split(r"\r\n|\r|\n", text)


def row(struct_id: str, elements: list[str], geometry, lattice=(), properties: dict | None = None) -> dict:
    return {
        "struct_id": struct_id,
        "elements": list(elements),
        "geometry": [[float(x) for x in p] for p in geometry],
        "lattice": [[float(x) for x in v] for v in lattice],
        "properties": {k: v if isinstance(v, str) else json.dumps(v) for k, v in (properties or {}).items()},
    }


def symbol(name: str) -> str:
    letters = re.match(r"[A-Za-z]+", name.strip())
    text = letters[0].capitalize() if letters else ""
    return next((s for s in (text[:2], text[:1]) if s in NUMBERS), text[:1])


def from_document(doc: dict, fallback: str) -> dict:
    """A structure document; unknown keys at its top join the properties."""
    known = {"struct_id", "geometry", "elements", "lattice", "properties"}
    more = {k: v for k, v in doc.items() if k not in known}
    elements = [e if isinstance(e, str) else next(s for s, z in NUMBERS.items() if z == e) for e in doc.get("elements", [])]
    return row(str(doc.get("struct_id") or fallback), elements, doc.get("geometry", []), doc.get("lattice") or [], {**(doc.get("properties") or {}), **more})


def parse_json(text: str, name: str) -> list[dict]:
    doc = json.loads(text)
    if "geometry" in doc or "struct_id" in doc:
        return [from_document(doc, name)]
    return [from_document(d, k) for k, d in doc.items()]


def parse_xyz(text: str, name: str) -> list[dict]:
    """Frames of: number of atoms, a comment, that many atoms. Several frames are numbered; blank lines end the file."""
    rows, at, lines = [], 0, lines_of(text)
    while at < len(lines) and lines[at].strip():
        n = int(lines[at])
        atoms = [line.split()[:4] for line in lines[at + 2 : at + 2 + n]]
        rows.append(([symbol(a[0]) for a in atoms], [list(map(float, a[1:])) for a in atoms]))
        at += 2 + n
    return [row(f"{name}_{k}", e, g) for k, (e, g) in enumerate(rows)]


def parse_geometry(text: str, name: str) -> list[dict]:
    """Lines lattice_vector x y z, atom x y z symbol, atom_frac a b c symbol; # begins a comment."""
    lattice, atoms = [], []
    for line in lines_of(text):
        words = line.split("#")[0].split()
        if not words:
            continue
        if words[0] == "lattice_vector":
            lattice.append(list(map(float, words[1:4])))
        elif words[0] in ("atom", "atom_frac"):
            atoms.append((words[0], list(map(float, words[1:4])), words[4]))
    geo = [np.array(p) @ np.array(lattice) if kind == "atom_frac" else p for kind, p, _ in atoms]
    return [row(name, [symbol(e) for _, _, e in atoms], geo, lattice)]


def cif_number(text: str) -> float:
    """A number, whose uncertainty in brackets goes."""
    return float(re.sub(r"\(.*\)", "", text))


def cif_tokens(text: str) -> list[str]:
    """Values and tags in order. Text between quotes, or between lines that begin with a semicolon, is one value."""
    out, held = [], None
    for line in lines_of(text):
        if held is not None:
            if line.startswith(";"):
                out.append("\n".join(held))
                held = None
            else:
                held.append(line)
        elif line.startswith(";"):
            held = [line[1:]]
        else:
            out += ["\0" + t[1:-1] if t[0] in "'\"" else t for t in re.findall(r"'[^']*(?:'(?=\S)[^']*)*'|\"[^\"]*\"|#.*|\S+", line) if not t.startswith("#")]
    return out


def cif_blocks(text: str) -> tuple[dict[str, str], list[tuple[list[str], list[list[str]]]]]:
    """Single tags with their values, and loops as (tags, rows)."""
    tokens, at, tags, loops = cif_tokens(text), 0, {}, []
    plain = lambda t: t.lstrip("\0")
    special = lambda t: t.startswith("_") or t.lower() == "loop_" or t.lower().startswith("data_")
    while at < len(tokens):
        t = tokens[at]
        if t.lower() == "loop_":
            names, at = [], at + 1
            while at < len(tokens) and tokens[at].startswith("_"):
                names.append(tokens[at].lower())
                at += 1
            values = []
            while at < len(tokens) and not special(tokens[at]):
                values.append(plain(tokens[at]))
                at += 1
            loops.append((names, [values[i : i + len(names)] for i in range(0, len(values) - len(names) + 1, len(names))]))
        elif t.startswith("_") and at + 1 < len(tokens):
            tags[t.lower()] = plain(tokens[at + 1])
            at += 2
        else:
            at += 1
    return tags, loops


def operation(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Matrix and shift of a symmetry operation such as -x+1/2,y,-z."""
    matrix, shift = np.zeros((3, 3)), np.zeros(3)
    for k, part in enumerate(text.replace(" ", "").lower().split(",")):
        for sign, a, b, axis in re.findall(r"([+-]?)(?:(\d+\.?\d*|\.\d+)(?:/(\d+))?)?\*?([xyz]?)", part):
            if not (a or axis):
                continue
            value = (float(a) if a else 1.0) / (float(b) if b else 1.0) * (-1 if sign == "-" else 1)
            if axis:
                matrix[k, "xyz".index(axis)] += value
            else:
                shift[k] += value
    return matrix, shift


def cell_rows(a: float, b: float, c: float, alpha: float, beta: float, gamma: float) -> np.ndarray:
    al, be, ga = (math.radians(x) for x in (alpha, beta, gamma))
    y = (math.cos(al) - math.cos(be) * math.cos(ga)) / math.sin(ga)
    return np.array([[a, 0, 0], [b * math.cos(ga), b * math.sin(ga), 0], [c * math.cos(be), c * y, c * math.sqrt(max(0.0, 1 - math.cos(be) ** 2 - y * y))]])


def parse_cif(text: str, name: str, tol: float = 0.05) -> list[dict]:
    """All atoms of the cell: sites are expanded by the symmetry operations, wrapped, and merged where they coincide (within
    tol Angstrom), as files may list atoms of neighbouring cells too. Other tags become properties."""
    tags, loops = cif_blocks(text)
    lattice = cell_rows(*(cif_number(tags[f"_cell_{k}"]) for k in ("length_a", "length_b", "length_c", "angle_alpha", "angle_beta", "angle_gamma")))
    ops, sites = ["x,y,z"], []
    for names, values in loops:
        for tag in ("_symmetry_equiv_pos_as_xyz", "_space_group_symop_operation_xyz"):
            if tag in names:
                ops = [v[names.index(tag)] for v in values]
        if "_atom_site_fract_x" in names:
            at = [names.index(f"_atom_site_fract_{c}") for c in "xyz"]
            label = names.index("_atom_site_type_symbol") if "_atom_site_type_symbol" in names else names.index("_atom_site_label")
            sites = [(symbol(v[label]), np.array([cif_number(v[i]) for i in at])) for v in values]
    elements: list[str] = []
    found: list[np.ndarray] = []
    moves = [operation(o) for o in ops]
    for e, f in sites:
        for matrix, shift in moves:
            g = (matrix @ f + shift) % 1.0
            if found:
                d = np.array(found) - g
                d = (d - np.round(d)) @ lattice
                if ((d**2).sum(-1) < tol * tol).any():
                    continue
            elements.append(e)
            found.append(g)
    more = {k: v for k, v in tags.items() if not k.startswith(("_atom_", "_cell_", "_symmetry_equiv"))}
    return [row(name, elements, np.array(found) @ lattice if found else [], lattice, more)]


PARSERS = {"json": parse_json, "xyz": parse_xyz, "geometry": parse_geometry, "cif": parse_cif}


def parse(content: bytes, path: str, file_format: str = "") -> list[dict]:
    """Structures of a file by its format, or its extension where none is given; an unknown or unreadable file has none."""
    kind = file_format or file_type(path)
    if kind not in PARSERS:
        return []
    name = PurePosixPath(path).name
    try:
        return PARSERS[kind](content.decode(), name.rpartition(".")[0] or name)
    except (ValueError, KeyError, IndexError, StopIteration, AttributeError, UnicodeDecodeError):
        return []


# Writers


def to_json(r: dict) -> str:
    keys = ("struct_id", "geometry", "elements", "lattice", "properties")
    return json.dumps({k: r[k] for k in keys})


def to_xyz(r: dict) -> str:
    atoms = [f"{e} {p[0]:.8f} {p[1]:.8f} {p[2]:.8f}" for e, p in zip(r["elements"], r["geometry"], strict=True)]
    return "\n".join([str(len(atoms)), r["struct_id"], *atoms]) + "\n"


def to_geometry(r: dict) -> str:
    cell = [f"lattice_vector {v[0]:.8f} {v[1]:.8f} {v[2]:.8f}" for v in r["lattice"]]
    return "\n".join([*cell, *(f"atom {p[0]:.8f} {p[1]:.8f} {p[2]:.8f} {e}" for e, p in zip(r["elements"], r["geometry"], strict=True))]) + "\n"


def to_cif(r: dict) -> str:
    lat = np.array(r["lattice"], float)
    n = np.linalg.norm(lat, axis=1)
    ang = [math.degrees(math.acos(np.clip(lat[i] @ lat[j] / (n[i] * n[j]), -1, 1))) for i, j in ((1, 2), (0, 2), (0, 1))]
    tags = [f"_cell_length_{k} {v:.8f}" for k, v in zip("abc", n, strict=True)] + [f"_cell_angle_{k} {v:.8f}" for k, v in zip(("alpha", "beta", "gamma"), ang, strict=True)]
    frac = np.array(r["geometry"], float) @ np.linalg.inv(lat)
    sites = [f"{e}{k} {e} {f[0]:.8f} {f[1]:.8f} {f[2]:.8f}" for k, (e, f) in enumerate(zip(r["elements"], frac, strict=True))]
    head = ["loop_", "_symmetry_equiv_pos_as_xyz", "'x, y, z'", "loop_", "_atom_site_label", "_atom_site_type_symbol", "_atom_site_fract_x", "_atom_site_fract_y", "_atom_site_fract_z"]
    return "\n".join([f"data_{r['struct_id']}", *tags, *head, *sites]) + "\n"


WRITERS = {"json": ("json", to_json), "xyz": ("xyz", to_xyz), "geometry": ("in", to_geometry), "cif": ("cif", to_cif)}
