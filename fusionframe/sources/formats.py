"""Readers and writers of the geometry files, over Spark's own file sources.

Every reader takes a path that Spark can open and gives rows with an explicit schema; files are
decoded in Arrow batches on the executors. Little-endian throughout; counts in the binary formats are floats.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<float>": pa.list_(pa.float32()), "array<int>": pa.list_(pa.int32()), "binary": pa.binary()}
CHUNK = 50_000  # rows of a batch


def decode_files(spark: SparkSession, path: str, schema: dict[str, str], decode: Callable[[bytes], dict], pattern: str | None = None) -> DataFrame:
    """path column, then the columns of `schema`, from a function that gives equal-length columns of one file."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    types = pa.schema([("path", pa.string()), *[(k, _ARROW[v]) for k, v in schema.items()]])

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                columns = decode(data)
                n = len(next(iter(columns.values())))
                for at in range(0, n, CHUNK):
                    part = {k: v[at : at + CHUNK] for k, v in columns.items()}
                    yield pa.RecordBatch.from_pydict({"path": [name] * min(CHUNK, n - at)} | part, schema=types)

    return reader.load(path).select("path", "content").mapInArrow(run, "path string, " + ", ".join(f"`{k}` {v}" for k, v in schema.items()))


_XYZ = {"idx": "bigint", "x": "double", "y": "double", "z": "double"}


def _points(p: np.ndarray) -> dict:
    return {"idx": np.arange(len(p)), "x": p[:, 0].astype(float), "y": p[:, 1].astype(float), "z": p[:, 2].astype(float)}


def parse_ply(data: bytes) -> dict:
    """Vertices of a binary little-endian or ascii PLY, by the names in its header."""
    end = data.index(b"end_header")
    end = data.index(b"\n", end) + 1
    lines = data[:end].decode("ascii", "replace").split("\n")
    kinds = {"float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8", "uchar": "u1", "uint8": "u1", "char": "i1", "int8": "i1", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2", "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4"}
    n, fields, current, ascii_ = 0, [], "", any("format ascii" in x for x in lines)
    for words in (x.split() for x in lines):
        if words[:1] == ["element"]:
            current = words[1]
            n = int(words[2]) if current == "vertex" else n
        elif words[:1] == ["property"] and current == "vertex":
            fields.append((words[2], kinds[words[1]]))
    if ascii_:
        rows = np.array([[float(v) for v in x.split()[: len(fields)]] for x in data[end:].decode("ascii").split("\n")[:n]]).reshape(n, -1)
        at = [[f for f, _ in fields].index(c) for c in "xyz"]
        return _points(rows[:, at])
    v = np.frombuffer(data, np.dtype(fields), n, end)
    return _points(np.stack([v["x"], v["y"], v["z"]], 1))


def scan_ply(spark: SparkSession, path: str) -> DataFrame:
    return decode_files(spark, path, _XYZ, parse_ply, "*.ply")


def ply_bytes(points: np.ndarray) -> bytes:
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(points)}\nproperty float x\nproperty float y\nproperty float z\nend_header\n"
    return head.encode() + np.ascontiguousarray(points, "<f4").tobytes()


def scan_keypoints(spark: SparkSession, path: str) -> DataFrame:
    """float count, then count x 3 floats."""

    def decode(data: bytes) -> dict:
        f = np.frombuffer(data, "<f4")
        return _points(f[1 : 1 + 3 * int(f[0])].reshape(-1, 3))

    return decode_files(spark, path, _XYZ, decode)


def keypoint_bytes(points: np.ndarray) -> bytes:
    return np.float32(len(points)).tobytes() + np.ascontiguousarray(points, "<f4").tobytes()


def scan_descriptors(spark: SparkSession, path: str) -> DataFrame:
    """float count, float dim, then count x dim floats."""

    def decode(data: bytes) -> dict:
        f = np.frombuffer(data, "<f4")
        n, dim = int(f[0]), int(f[1])
        return {"idx": np.arange(n), "desc": list(f[2 : 2 + n * dim].reshape(n, dim))}

    return decode_files(spark, path, {"idx": "bigint", "desc": "array<float>"}, decode)


def descriptor_bytes(rows: np.ndarray) -> bytes:
    return np.array(rows.shape, "<f4").tobytes() + np.ascontiguousarray(rows, "<f4").tobytes()


_GRID = {"ix": "int", "iy": "int", "iz": "int", "value": "double", "origin": "array<double>", "pose": "array<double>"}


def scan_tdf(spark: SparkSession, path: str, with_pose: bool = False) -> DataFrame:
    """Non-zero voxels: 3 sizes, 3 origin values, a 4x4 pose if there is one, values with x fastest."""

    def decode(data: bytes) -> dict:
        f = np.frombuffer(data, "<f4")
        nx, ny, nz = (int(v) for v in f[:3])
        head = 22 if with_pose else 6
        v = f[head : head + nx * ny * nz]
        at = np.flatnonzero(v)
        origin, pose = f[3:6].astype(float), f[6:22].astype(float) if with_pose else None
        return {"ix": (at % nx).astype(np.int32), "iy": (at // nx % ny).astype(np.int32), "iz": (at // (nx * ny)).astype(np.int32), "value": v[at].astype(float), "origin": [origin] * len(at), "pose": [pose] * len(at)}

    return decode_files(spark, path, _GRID, decode)


def tdf_bytes(grid: np.ndarray, origin, pose=None) -> bytes:
    """grid by [z, y, x]."""
    head = [*grid.shape[::-1], *origin, *([] if pose is None else np.ravel(pose))]
    return np.array(head, "<f4").tobytes() + np.ascontiguousarray(grid, "<f4").tobytes()


def scan_volumes(spark: SparkSession, path: str) -> DataFrame:
    """float n, 3 sizes, then n volumes; the last batch counts like the others."""

    def decode(data: bytes) -> dict:
        f = np.frombuffer(data, "<f4")
        n, size = int(f[0]), int(f[1] * f[2] * f[3])
        return {"idx": np.arange(n), "patch": list(f[4 : 4 + n * size].reshape(n, size))}

    return decode_files(spark, path, {"idx": "bigint", "patch": "array<float>"}, decode)


def scan_raw_grid(spark: SparkSession, path: str, dims: tuple[int, int, int]) -> DataFrame:
    """float32 values with x fastest; the sizes stand in a file beside it (see parse_size)."""

    def decode(data: bytes) -> dict:
        v = np.frombuffer(data, "<f4")[: dims[0] * dims[1] * dims[2]]
        at = np.flatnonzero(v)
        return {"ix": (at % dims[0]).astype(np.int32), "iy": (at // dims[0] % dims[1]).astype(np.int32), "iz": (at // (dims[0] * dims[1])).astype(np.int32), "value": v[at].astype(float)}

    return decode_files(spark, path, {k: _GRID[k] for k in ("ix", "iy", "iz", "value")}, decode)


def parse_size(text: str) -> tuple[int, int, int]:
    """(nx, ny, nz) of `Float32(nx,ny,nz,1)`."""
    inner = text[text.index("(") + 1 : text.index(")")].split(",")
    return tuple(int(x) for x in inner[:3])


def png16(data: bytes) -> np.ndarray:
    """Grey PNG of 8 or 16 bits, not interlaced, as rows of numbers."""
    at, packed, width, height, depth = 8, b"", 0, 0, 16
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if color or interlace or depth not in (8, 16):
                raise ValueError("only grey images of 8 or 16 bits, not interlaced")
        elif kind == b"IDAT":
            packed += body
        at += 12 + size
    step = depth // 8
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * step)
    out, above = np.zeros((height, width * step), np.uint8), np.zeros(width * step, np.uint8)
    for y in range(height):
        kind, row = raw[y, 0], raw[y, 1:]
        if kind == 0:
            line = row.copy()
        elif kind == 2:
            line = row + above
        elif kind == 1:
            line = np.cumsum(row.reshape(-1, step), 0, dtype=np.uint8).ravel()
        else:
            line = np.zeros(width * step, np.uint8)
            for x in range(width * step):
                left, up, corner = (int(line[x - step]) if x >= step else 0), int(above[x]), (int(above[x - step]) if x >= step else 0)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                line[x] = (int(row[x]) + guess) & 255
        out[y] = above = line
    return out.view(">u2").astype(np.uint16) if step == 2 else out


def png16_bytes(image: np.ndarray) -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + np.ascontiguousarray(r, ">u2").tobytes() for r in image)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 16, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def scan_depth(spark: SparkSession, path: str, most: float = 6.0) -> DataFrame:
    """path, px, py, d in metres of 16-bit millimetre images; beyond `most` it is 0, which stays as missing."""

    def decode(data: bytes) -> dict:
        d = png16(data) / 1000.0
        d = np.where(d > most, 0.0, d)
        y, x = np.indices(d.shape)
        return {"px": x.ravel().astype(np.int32), "py": y.ravel().astype(np.int32), "d": d.ravel()}

    return decode_files(spark, path, {"px": "int", "py": "int", "d": "double"}, decode, "*.png")


_TENSOR = {0: "<f2", 1: "<f4", 2: "<f8", 3: "u1", 4: "<u2", 5: "<u4", 6: "<u8", 7: "i1", 8: "<i2", 9: "<i4", 10: "<i8", 11: "S1", 12: "?"}


def scan_tensors(spark: SparkSession, path: str) -> DataFrame:
    """name, shape, data of typed tensors one after another: type byte, element size, name length, name, rank, sizes, values."""

    def decode(data: bytes) -> dict:
        at, out = 0, {"name": [], "shape": [], "data": []}
        while at < len(data):
            kind = data[at]
            _, size = struct.unpack_from("<Ii", data, at + 1)
            at += 9
            out["name"].append(data[at : at + size].decode())
            (rank,) = struct.unpack_from("<i", data, at + size)
            at += size + 4
            shape = struct.unpack_from(f"<{rank}i", data, at)
            at += 4 * rank
            v = np.frombuffer(data, _TENSOR[kind], int(np.prod(shape)), at)
            at += v.nbytes
            out["shape"].append(list(shape))
            out["data"].append(v.astype(float))
        return out

    return decode_files(spark, path, {"name": "string", "shape": "array<int>", "data": "array<double>"}, decode)


def tensor_bytes(name: str, values: np.ndarray, kind: int = 1) -> bytes:
    v = np.ascontiguousarray(values, _TENSOR[kind])
    return bytes([kind]) + struct.pack("<Ii", v.itemsize, len(name)) + name.encode() + struct.pack(f"<i{v.ndim}i", v.ndim, *v.shape) + v.tobytes()


# --- text formats, by Spark's own functions ---


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.filter(F.split("value", r"\s+"), lambda x: x != "").alias("t"))


def _blocks(spark: SparkSession, path: str, size: int, name: str) -> DataFrame:
    step = 3 + size * size
    t = _tokens(spark, path).select("path", "t", F.posexplode(F.sequence(F.lit(0), F.greatest(F.floor(F.size("t") / step).cast("int") - 1, F.lit(0)))).alias("block", "k")).where(F.size("t") >= step)
    head = [F.get("t", F.col("k") * step + i).cast("int").alias(n) for i, n in enumerate(("i", "j", "n"))]
    body = F.transform(F.slice("t", F.col("k") * step + 4, size * size), lambda x: x.cast("double"))
    return t.select("path", "block", *head, body.alias(name))


def scan_log(spark: SparkSession, path: str) -> DataFrame:
    """path, block, i, j, n, trans: blocks of three integers and a 4x4 matrix."""
    return _blocks(spark, path, 4, "trans")


def scan_info(spark: SparkSession, path: str) -> DataFrame:
    """path, block, i, j, n, info: blocks of three integers and a 6x6 matrix."""
    return _blocks(spark, path, 6, "info")


def scan_matrix(spark: SparkSession, path: str) -> DataFrame:
    return _tokens(spark, path).select("path", F.transform("t", lambda x: x.cast("double")).alias("m"))


def scan_labels(spark: SparkSession, path: str) -> DataFrame:
    """path, idx, value after a first line with the count."""
    t = _tokens(spark, path)
    return t.select("path", F.posexplode(F.slice("t", F.lit(2), F.get("t", F.lit(0)).cast("int"))).alias("idx", "v")).select("path", "idx", F.col("v").cast("double").alias("value"))


def scan_keypoint_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", comment="#", schema="idx int, file string, x int, y int")


def _headed(spark: SparkSession, path: str, head: dict[str, str], matrix: str) -> DataFrame:
    """path, the fields of a first line, and the 4x4 matrix after it, of files that hold one of each; shorter files have nulls."""
    t = _tokens(spark, path)
    fields = [F.get("t", F.lit(k)).try_cast(kind).alias(name) for k, (name, kind) in enumerate(head.items())]
    body = F.transform(F.slice("t", len(head) + 1, 16), lambda x: x.try_cast("double"))
    return t.select("path", *fields, F.when(F.size("t") >= len(head) + 16, body).alias(matrix))


def scan_fragment_info(spark: SparkSession, path: str) -> DataFrame:
    """path, scene, seq, first, last, pose: what a fragment was fused from, and the pose of its first frame."""
    return _headed(spark, path, {"scene": "string", "seq": "string", "first": "int", "last": "int"}, "pose")


def scan_registration(spark: SparkSession, path: str) -> DataFrame:
    """path, fragment1, fragment2, inliers, ratio, overlap1, overlap2, trans: results of registering pairs."""
    return _headed(spark, path, {"fragment1": "string", "fragment2": "string", "inliers": "int", "ratio": "double", "overlap1": "double", "overlap2": "double"}, "trans")


def _matrix_lines(name: str) -> Column:
    row = lambda r: F.format_string("%15.8e\t %15.8e\t %15.8e\t %15.8e\t", *[F.col(name)[4 * r + c] for c in range(4)])
    return F.concat_ws("\n", *[row(r) for r in range(4)])


def fragment_lines(fragments: DataFrame) -> DataFrame:
    """The fragments' columns and value, their text as `scan_fragment_info` reads it, for DataFrame.write.text with partitionBy (one fragment a folder)."""
    return fragments.withColumn("value", F.concat_ws("\n", F.format_string("%s\t %s\t %d\t %d\t", "scene", "seq", "first", "last"), _matrix_lines("pose")))


def registration_lines(pairs: DataFrame) -> DataFrame:
    """The pairs' columns and value, their text as `scan_registration` reads it, for DataFrame.write.text with partitionBy (one pair a folder)."""
    head = F.concat_ws("\n", F.format_string("%s\t %s\t", "fragment1", "fragment2"), F.format_string("%d\t %15.8e\t %15.8e\t %15.8e\t", "inliers", "ratio", "overlap1", "overlap2"))
    return pairs.withColumn("value", F.concat_ws("\n", head, _matrix_lines("trans")))


def write_distances(distances: DataFrame, path: str, order: str, value: str = "distance") -> None:
    """A folder of text parts that, one after another, hold the number of distances and then each, in the order of a column; parts are ranges, so no task sorts all."""
    count = distances.agg(F.count("*").cast("string").alias("value"), F.lit(0).alias("part")).withColumn("at", F.lit(None).cast(distances.schema[order].dataType))
    rows = distances.select(F.col(value).cast("string").alias("value"), F.lit(1).alias("part"), F.col(order).alias("at")).unionByName(count)
    rows.repartitionByRange("part", "at").sortWithinPartitions("part", "at").select("value").write.mode("overwrite").text(path)


def scan_off(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(mesh, vid, x, y, z) and (mesh, fid, v0, v1, v2) of OFF files; faces of more corners become fans."""

    def vertices(data: bytes) -> dict:
        t = data.split()
        n = int(t[1])
        return _points(np.array(t[4 : 4 + 3 * n], float).reshape(n, 3))

    def faces(data: bytes) -> dict:
        t = data.split()
        at, out = 4 + 3 * int(t[1]), []
        for _ in range(int(t[2])):
            k = int(t[at])
            v = [int(x) for x in t[at + 1 : at + 1 + k]]
            out += [(v[0], v[i], v[i + 1]) for i in range(1, k - 1)]
            at += 1 + k
        f = np.array(out, np.int64).reshape(-1, 3)
        return {"fid": np.arange(len(f)), "v0": f[:, 0], "v1": f[:, 1], "v2": f[:, 2]}

    v = decode_files(spark, path, _XYZ, vertices, "*.off").select(F.col("path").alias("mesh"), F.col("idx").alias("vid"), "x", "y", "z")
    return v, decode_files(spark, path, {c: "bigint" for c in ("fid", "v0", "v1", "v2")}, faces, "*.off").withColumnRenamed("path", "mesh")


def log_lines(log: DataFrame, matrix: str = "trans", size: int = 4, fmt: str = "%15.8e") -> DataFrame:
    """scene, i, j, value: the block of each pair as text, for DataFrame.write.text with partitionBy(scene)."""
    m: Column = F.col(matrix)
    rows = [F.format_string("\t".join([fmt] * size), *[m[size * r + c] for c in range(size)]) for r in range(size)]
    return log.select(*[c for c in log.columns if c in ("scene", "i", "j")], F.concat_ws("\n", F.format_string("%d\t%d\t%d", "i", "j", "n"), *rows).alias("value"))


def write_text_log(log: DataFrame, path: str, matrix: str = "trans", size: int = 4) -> None:
    log_lines(log, matrix, size).orderBy("i", "j").select("value").write.mode("overwrite").text(path)


def write_files(df: DataFrame, key: str, encode: Callable, path: str) -> DataFrame:
    """key, content: one binary value per group (for a sink of files or objects), encoded on the executors."""
    kind = df.schema[key].dataType.simpleString()

    def one(pdf):
        import pandas as pd

        return pd.DataFrame({key: [pdf[key].iloc[0]], "content": [encode(pdf)]})

    out = df.groupBy(key).applyInPandas(one, f"`{key}` {kind}, content binary")
    out.write.mode("overwrite").parquet(path)
    return out
