"""Vocabulary artefacts: JSON, merge list and binary file, written and read strictly.

A vocabulary has 65,536 ids at most, so that the driver handles its files; Spark's file systems are used for access.
"""

from __future__ import annotations

import json
import re
import struct

from pyspark.sql import SparkSession

from corpusloom.functions.rules import BASE_SIZE
from corpusloom.operators.vocabulary import MAX_PACKED, Vocabulary, from_triples

# Fixed values of the binary format.
MAGIC = b"DOMBPE02"
VERSIONS = (1, 2)
MATRIX_SIDE, ALIGNMENT = 2_048, 64

_JSON = {0x08: "\\b", 0x0C: "\\f", 0x0A: "\\n", 0x0D: "\\r", 0x09: "\\t", 0x22: '\\"', 0x5C: "\\\\"}


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    target, system = _path(spark, path)
    out = system.create(target, True)
    out.write(bytearray(data))
    out.close()


def read_bytes(spark: SparkSession, path: str) -> bytes:
    target, system = _path(spark, path)
    if not system.exists(target):
        raise FileNotFoundError(path)
    return bytes(spark.read.format("binaryFile").load(path).first().content)


def vocabulary_json(vocabulary: Vocabulary) -> str:
    """One line of ASCII; a byte is the character of its number."""
    text = lambda data: "".join(_JSON.get(b) or (chr(b) if 0x20 <= b <= 0x7E else f"\\u00{b:02x}") for b in data)
    tokens = ",".join(f'{{"id":{k},"text":"{text(vocabulary.bytes_of(k))}"}}' for k in range(len(vocabulary)))
    return f'{{"version":1,"vocab_size":{len(vocabulary)},"tokens":[{tokens}]}}'


def parse_vocabulary_json(text: str, strict: bool = False) -> dict[int, bytes]:
    """Ids and bytes. Records may be in any order; ``strict`` wants them in sequence, and the size to agree."""
    data = json.loads(text)
    found: dict[int, bytes] = {}
    for k, token in enumerate(data["tokens"]):
        if strict and token["id"] != k:
            raise ValueError(f"token {k} has the id {token['id']}")
        if token["id"] in found:
            raise ValueError(f"the id {token['id']} is listed twice")
        if any(ord(c) > 0xFF for c in token["text"]):
            raise ValueError(f"token {token['id']} has a character that is no byte")
        found[token["id"]] = token["text"].encode("latin-1")
    if strict and (data.get("vocab_size") != len(found) or found.get(0) != b"\0" or len(found.get(255, b"")) != 1):
        raise ValueError("the vocabulary does not agree with its size, or its bytes are not in order")
    return found


def merges_text(vocabulary: Vocabulary) -> str:
    return "".join(f"{a} {b} -> {BASE_SIZE + k}\n" for k, (a, b) in enumerate(vocabulary.merges))


def parse_merges(text: str) -> Vocabulary:
    """Blank lines and lines that begin with # are skipped; ids must be in sequence, components known, pairs new."""
    triples = []
    for number, line in enumerate(text.splitlines(), 1):
        if not line.strip() or line.startswith("#"):
            continue
        fields = re.fullmatch(r"\s*(\d+) (\d+) -> (\d+)\s*", line)
        if fields is None:
            raise ValueError(f"line {number} is no merge: {line!r}")
        triples.append(tuple(int(f) for f in fields.groups()))
    return from_triples(triples)


def load_vocabulary(vocabulary_text: str, merges: str) -> Vocabulary:
    """Both files together: the bytes must be all there, merged entries must agree where they are listed, and no others may be."""
    made, listed = parse_merges(merges), parse_vocabulary_json(vocabulary_text)
    for k in range(BASE_SIZE):
        if listed.get(k) != bytes([k]):
            raise ValueError(f"the base entry {k} is missing or wrong")
    for k, data in listed.items():
        if k >= len(made) or made.bytes_of(k) != data:
            raise ValueError(f"the entry {k} does not agree with the merges")
    if len(listed) not in (BASE_SIZE, len(made)):
        raise ValueError("the sizes of the vocabulary and the merges differ")
    return made


def vocabulary_binary(vocabulary: Vocabulary, version: int = 2) -> bytes:
    """Header, byte offsets, bytes, merges; from version 2 on the padded rank matrix, which only vocabularies of up to 2,048 ids have in full."""
    size = len(vocabulary)
    if size > MAX_PACKED:
        raise ValueError(f"{size} ids do not fit 16 bits")
    if version not in VERSIONS:
        raise ValueError(f"unknown version {version}")
    if version == 2 and size > MATRIX_SIDE:
        raise ValueError(f"the rank matrix holds {MATRIX_SIDE} ids; write version 1")
    data = [vocabulary.bytes_of(k) for k in range(size)]
    offsets = [0]
    for d in data:
        offsets.append(offsets[-1] + len(d))
    out = MAGIC + struct.pack("<III", version, size, len(vocabulary.merges)) + struct.pack(f"<{size + 1}I", *offsets) + b"".join(data)
    out += b"".join(struct.pack("<4H", a, b, BASE_SIZE + k, 0) for k, (a, b) in enumerate(vocabulary.merges))
    if version == 2:
        matrix = bytearray(2 * MATRIX_SIDE * size)
        for k, (a, b) in enumerate(vocabulary.merges):
            struct.pack_into("<H", matrix, 2 * (a * MATRIX_SIDE + b), BASE_SIZE + k + 1)
        out += b"\0" * (-len(out) % ALIGNMENT) + bytes(matrix)
    return out


def parse_vocabulary_binary(data: bytes) -> Vocabulary:
    if len(data) < 20:
        raise ValueError("truncated header")
    if data[:8] != MAGIC:
        raise ValueError("bad magic")
    version, size, count = struct.unpack_from("<III", data, 8)
    if version not in VERSIONS or not 0 < size <= MAX_PACKED:
        raise ValueError("bad header")
    begin = 20 + 4 * (size + 1)
    if len(data) < begin:
        raise ValueError("truncated offsets")
    offsets = struct.unpack_from(f"<{size + 1}I", data, 20)
    if any(b < a for a, b in zip(offsets, offsets[1:], strict=False)):
        raise ValueError("corrupt offsets")
    merges_at = begin + offsets[-1]
    end = merges_at + 8 * count
    if len(data) < end:
        raise ValueError("truncated body")
    made = from_triples(struct.unpack_from("<3H", data, merges_at + 8 * k) for k in range(count))
    if len(made) != size or any(made.bytes_of(k) != data[begin + offsets[k] : begin + offsets[k + 1]] for k in range(size)):
        raise ValueError("the tokens do not agree with the merges")
    if version == 2:
        matrix = end + (-end % ALIGNMENT)
        if len(data) < matrix + 2 * MATRIX_SIDE * size:
            raise ValueError("truncated matrix")
        for k, (a, b) in enumerate(made.merges):
            if struct.unpack_from("<H", data, matrix + 2 * (a * MATRIX_SIDE + b))[0] != BASE_SIZE + k + 1:
                raise ValueError("the matrix does not agree with the merges")
    return made


def save(spark: SparkSession, vocabulary: Vocabulary, folder: str) -> None:
    write_bytes(spark, f"{folder}/vocab.json", vocabulary_json(vocabulary).encode())
    write_bytes(spark, f"{folder}/merges.txt", merges_text(vocabulary).encode())
    write_bytes(spark, f"{folder}/vocab.bin", vocabulary_binary(vocabulary, 2 if len(vocabulary) <= MATRIX_SIDE else 1))


def load(spark: SparkSession, folder: str) -> Vocabulary:
    return load_vocabulary(read_bytes(spark, f"{folder}/vocab.json").decode("ascii"), read_bytes(spark, f"{folder}/merges.txt").decode("ascii"))
