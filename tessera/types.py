"""Enumerations, schemas and errors of the engine."""

from __future__ import annotations

from enum import Enum, IntEnum

from pyspark.sql import types as T

VECTOR_SCHEMA = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("tag", T.LongType(), False), T.StructField("vector", T.ArrayType(T.FloatType(), False), False)])
KV_SCHEMA = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("value", T.BinaryType(), False)])
LOG_SCHEMA = T.StructType([T.StructField("seq", T.LongType(), False), T.StructField("op", T.StringType(), False), *VECTOR_SCHEMA.fields[:1], T.StructField("tag", T.LongType(), True), T.StructField("vector", T.ArrayType(T.FloatType(), False), True)])


class Method(Enum):
    """Distance methods: code, whether smaller is better, and the value that pads a result."""

    L2NORM = (0, True, float("inf"))
    COSINE = (1, False, -1.0)
    DOTP = (2, False, -1.0)

    @property
    def code(self) -> int:
        return self.value[0]

    @property
    def smaller_is_better(self) -> bool:
        return self.value[1]

    @property
    def worst(self) -> float:
        return self.value[2]

    @classmethod
    def of(cls, method: Method | str | int) -> Method:
        for m in cls:
            if method in (m, m.name, m.code):
                return m
        raise InvalidMethod(f"no such method: {method}")


class IndexType(IntEnum):
    FLAT_INDEX = 0
    NSW_INDEX = 3
    HNSW_INDEX = 3

    @property
    def label(self) -> str:
        return "flat" if self is IndexType.FLAT_INDEX else "hnsw"


class ImportMode(IntEnum):
    OVERWRITE = 0
    IGNORE_VERBOSE = 1
    IGNORE = 2


class TesseraError(Exception):
    """``code`` is the number of the error, ``message`` its standing text."""

    code = -1
    message = "error"

    def __init__(self, detail: str = ""):
        super().__init__(f"{self.message}: {detail}" if detail else self.message)


def _errors(base: type, table: list[tuple[int, str, str]]) -> dict[str, type]:
    return {name: type(name, (base,), {"code": code, "message": message}) for code, name, message in table}


class IndexError_(TesseraError):
    pass


class KVError(TesseraError):
    pass


_INDEX = _errors(
    IndexError_,
    [
        (1, "InvalidInit", "the table is not initialised"),
        (2, "InvalidIndex", "no such table"),
        (3, "InvalidVector", "the vector is missing or not finite"),
        (4, "InvalidIndexType", "no such type of index"),
        (5, "InvalidResult", "no place for results"),
        (6, "InvalidDimensions", "the number of dimensions differs"),
        (7, "InvalidArgument", "an argument is out of range"),
        (8, "InvalidId", "ids begin at 1"),
        (9, "InvalidRef", "no such reference"),
        (10, "InvalidMethod", "no such method"),
        (11, "DuplicatedEntry", "the id is there already"),
        (12, "NotFoundId", "the id is not there"),
        (13, "IndexEmpty", "the table is empty"),
        (14, "ThreadError", "a task failed"),
        (15, "SystemError_", "a system call failed"),
        (16, "FileIOError", "a file cannot be read or written"),
        (17, "NotImplemented_", "not supported by this type of index"),
        (18, "InvalidFile", "the file is of another kind"),
    ],
)
_KV = _errors(
    KVError,
    [
        (1, "KVKeyNotFound", "the key is not there"),
        (2, "KVSystemError", "a system call failed"),
        (3, "KVInvalidTable", "no such table"),
        (4, "KVInvalidKey", "the key is empty"),
        (5, "KVInvalidValue", "the value is empty"),
        (6, "KVFileIO", "a file cannot be read or written"),
        (7, "KVFileInvalid", "the file is of another kind"),
        (8, "KVMismatchElementCount", "the number of elements differs"),
    ],
)
InvalidInit, InvalidIndex, InvalidVector = _INDEX["InvalidInit"], _INDEX["InvalidIndex"], _INDEX["InvalidVector"]
InvalidIndexType, InvalidResult, InvalidDimensions = _INDEX["InvalidIndexType"], _INDEX["InvalidResult"], _INDEX["InvalidDimensions"]
InvalidArgument, InvalidId, InvalidRef, InvalidMethod = _INDEX["InvalidArgument"], _INDEX["InvalidId"], _INDEX["InvalidRef"], _INDEX["InvalidMethod"]
DuplicatedEntry, NotFoundId, IndexEmpty = _INDEX["DuplicatedEntry"], _INDEX["NotFoundId"], _INDEX["IndexEmpty"]
ThreadError, SystemError_, FileIOError = _INDEX["ThreadError"], _INDEX["SystemError_"], _INDEX["FileIOError"]
NotImplemented_, InvalidFile = _INDEX["NotImplemented_"], _INDEX["InvalidFile"]
KVKeyNotFound, KVSystemError, KVInvalidTable, KVInvalidKey = _KV["KVKeyNotFound"], _KV["KVSystemError"], _KV["KVInvalidTable"], _KV["KVInvalidKey"]
KVInvalidValue, KVFileIO, KVFileInvalid, KVMismatchElementCount = _KV["KVInvalidValue"], _KV["KVFileIO"], _KV["KVFileInvalid"], _KV["KVMismatchElementCount"]


def index_strerror(code: int) -> str:
    return "success" if code == 0 else next((e.message for e in _INDEX.values() if e.code == code), "unknown error")


def table_strerror(code: int) -> str:
    return "success" if code == 0 else next((e.message for e in _KV.values() if e.code == code), "unknown error")
