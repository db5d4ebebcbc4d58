"""From the bytes of one file to rows. Nothing here knows Spark."""

from __future__ import annotations

import io
import re

import numpy as np

#: Names of number types in polygon files.
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def npz_points(data: bytes) -> dict[str, np.ndarray]:
    """Columns x, y, z and, if there, nx.., r.., label of an archive with points, normals, colors, labels."""
    out: dict[str, np.ndarray] = {}
    with np.load(io.BytesIO(data)) as f:
        for key, names in (("points", ("x", "y", "z")), ("normals", ("nx", "ny", "nz")), ("colors", ("r", "g", "b"))):
            if key in f:
                values = f[key].astype(np.float64)
                out |= {n: values[:, k] for k, n in enumerate(names)}
        if "labels" in f:
            out["label"] = f["labels"].reshape(-1).astype(np.int64)
    return out


def ply_header(data: bytes) -> tuple[str, list[tuple[str, int, list]], bytes]:
    """Format, elements (name, rows, properties (name, type or (count type, value type))) and the body."""
    end = re.search(rb"end_header[ \t]*\r?\n", data)
    if end is None:
        raise ValueError("no end of the header")
    form, elements = "ascii", []
    for line in data[: end.start()].decode("ascii", "replace").splitlines():
        word = line.split()
        if word[:1] == ["format"]:
            form = word[1]
        elif word[:1] == ["element"]:
            elements.append((word[1], int(word[2]), []))
        elif word[:1] == ["property"]:
            elements[-1][2].append((word[-1], PLY_TYPES[word[1]] if word[1] != "list" else (PLY_TYPES[word[2]], PLY_TYPES[word[3]])))
    return form, elements, data[end.end() :]


def equal_lists(body: bytes, at: int, count: int, props: list, order: str) -> np.ndarray | None:
    """The rows of an element whose lists are all as long as those of its first row, as one structured array; else None."""
    fields, spot = [], at
    for n, t in props:
        if isinstance(t, tuple):
            if spot + np.dtype(t[0]).itemsize > len(body):
                return None
            size = int(np.frombuffer(body, order + t[0], 1, spot)[0])
            fields += [(f"size of {n}", order + t[0]), (n, order + t[1], (size,))]
            spot += np.dtype(t[0]).itemsize + size * np.dtype(t[1]).itemsize
        else:
            fields.append((n, order + t))
            spot += np.dtype(t).itemsize
    kind = np.dtype(fields)
    if at + count * kind.itemsize > len(body):
        return None
    rows = np.frombuffer(body, kind, count, at)
    same = all((rows[f"size of {n}"] == rows[n].shape[1]).all() for n, t in props if isinstance(t, tuple))
    return rows if same else None


def ply_elements(data: bytes) -> dict[str, dict]:
    """Elements of a polygon file, ascii or binary (either byte order), as columns; of lists, a list of arrays."""
    form, elements, body = ply_header(data)
    order = ">" if form.endswith("big_endian") else "<"
    tokens, at, out = body.split() if form == "ascii" else None, 0, {}
    for name, count, props in elements:
        if not any(isinstance(t, tuple) for _, t in props):
            if tokens is not None:
                rows = np.array(tokens[at : at + count * len(props)], np.float64).reshape(count, len(props))
                out[name] = {n: rows[:, k] for k, (n, _) in enumerate(props)}
                at += count * len(props)
            else:
                kind = np.dtype([(n, order + t) for n, t in props])
                rows = np.frombuffer(body, kind, count, at)
                out[name] = {n: rows[n].astype(np.float64) for n, _ in props}
                at += count * kind.itemsize
            continue
        if tokens is None and (rows := equal_lists(body, at, count, props, order)) is not None:  # no need to go row by row
            out[name] = {n: list(rows[n].astype(np.float64)) if isinstance(t, tuple) else rows[n].astype(np.float64) for n, t in props}
            at += rows.nbytes
            continue
        found: dict[str, list] = {n: [] for n, _ in props}
        for _ in range(count):  # lists of any length: row by row
            for n, t in props:
                if tokens is not None:
                    size = int(tokens[at]) if isinstance(t, tuple) else 1
                    at += isinstance(t, tuple)
                    values = np.array(tokens[at : at + size], np.float64)
                    at += size
                else:
                    size = 1
                    if isinstance(t, tuple):
                        size, at, t = int(np.frombuffer(body, order + t[0], 1, at)[0]), at + np.dtype(t[0]).itemsize, t[1]
                    values = np.frombuffer(body, order + t, size, at).astype(np.float64)
                    at += size * np.dtype(t).itemsize
                found[n].append(values)
        out[name] = {n: v if isinstance(dict(props)[n], tuple) else np.concatenate([*v, np.zeros(0)]) for n, v in found.items()}
    return out


def triangles(polygons: list) -> np.ndarray:
    """Polygons as fans of triangles around their first corners; fewer than three corners make none."""
    if polygons and len(polygons[0]) >= 3 and len({len(p) for p in polygons}) == 1:
        corners = np.asarray(polygons)
        fans = [corners[:, [0, k, k + 1]] for k in range(1, corners.shape[1] - 1)]
        return np.stack(fans, 1).reshape(-1, 3).astype(np.int64)
    out = [(p[0], p[k], p[k + 1]) for p in polygons for k in range(1, len(p) - 1)]
    return np.array(out, np.int64).reshape(-1, 3)


def ply_points(data: bytes) -> dict[str, np.ndarray]:
    vertex = ply_elements(data).get("vertex", {})
    names = {"red": "r", "green": "g", "blue": "b"}
    return {names.get(n, n): v for n, v in vertex.items() if names.get(n, n) in ("x", "y", "z", "nx", "ny", "nz", "r", "g", "b", "label")}


def lidar_points(data: bytes) -> dict[str, np.ndarray]:
    """Records of four little-endian floats."""
    rows = np.frombuffer(data, "<f4").reshape(-1, 4).astype(np.float64)
    return {n: rows[:, k] for k, n in enumerate(("x", "y", "z", "intensity"))}


def off_mesh(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and triangles; the counts may be glued to the word OFF."""
    text = data.decode("ascii", "replace").lstrip()
    tokens = (text[3:] if text.startswith("OFF") else text).split()
    nv, nf = int(tokens[0]), int(tokens[1])
    vertices = np.array(tokens[3 : 3 + 3 * nv], np.float64).reshape(nv, 3)
    rest, at, faces = tokens[3 + 3 * nv :], 0, []
    for _ in range(nf):
        n = int(rest[at])
        faces.append([int(v) for v in rest[at + 1 : at + 1 + n]])
        at += n + 1
    return vertices, triangles(faces)


def obj_mesh(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and triangles of ``v`` and ``f`` lines; corners count from 1, or back from the last vertex so far if negative."""
    vertices, faces = [], []
    for line in data.decode("utf-8", "replace").replace("\\\n", " ").splitlines():
        kind, *rest = line.split() or [""]
        if kind == "v":
            vertices.append([float(x) for x in rest[:3]])
        elif kind == "f":
            corners = [int(x.partition("/")[0]) for x in rest]
            faces.append([c - 1 if c > 0 else len(vertices) + c for c in corners])
    return np.array(vertices, np.float64).reshape(-1, 3), triangles(faces)


def ply_mesh(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    parts = ply_elements(data)
    vertex, face = parts.get("vertex", {}), parts.get("face", {})
    corners = next((v for v in face.values() if isinstance(v, list)), [])
    return np.stack([vertex[c] for c in "xyz"], 1), triangles(corners)


#: By what follows the last dot of a path; files of other kinds are read as OFF.
MESHES = {"ply": ply_mesh, "obj": obj_mesh}


def npz_bytes(columns: dict[str, np.ndarray]) -> bytes:
    """Named arrays points, normals, features and labels of the columns that there are."""
    arrays = {}
    for key, names in (("points", ("x", "y", "z")), ("normals", ("nx", "ny", "nz")), ("features", sorted((n for n in columns if re.fullmatch(r"f[0-9]+", n)), key=lambda n: int(n[1:])))):
        if names and all(n in columns for n in names):
            arrays[key] = np.stack([columns[n] for n in names], 1).astype(np.float64)
    if "label" in columns:
        arrays["labels"] = np.asarray(columns["label"]).astype(np.int32)
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def ply_bytes(columns: dict[str, np.ndarray]) -> bytes:
    """A binary polygon file with one vertex property (double) for each column."""
    size = len(next(iter(columns.values()), ()))
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {size}\n" + "".join(f"property double {n}\n" for n in columns) + "end_header\n"
    body = np.stack([np.asarray(v, "<f8") for v in columns.values()], 1) if columns else np.zeros((0, 0), "<f8")
    return head.encode() + body.tobytes()
