"""The range coder of token ids (RangeCoder.java) as column functions.

A sequential coder of a few bytes an id is no work for Python or for columns of numbers. So it is one small JVM class: the
driver compiles it with the compiler that Spark brings along for its generated code, writes it as a jar into the shared
folder, and adds that jar to the session, from which executors fetch it (new ones too, after a loss).
"""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .shared import new_folder, put_file

#: Ids of a block; as in RangeCoder.java.
BLOCK = 1 << 15
TOTAL = 1 << 16
_NAME = "tidelog.llm.RangeCoder"
#: By application: the classes' loader.
_loaders: dict = {}


def _loader(spark: SparkSession):
    app = spark.sparkContext.applicationId
    if app not in _loaders:
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(spark._jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(Path(__file__).with_name("RangeCoder.java").read_text())
        jar = io.BytesIO()
        with zipfile.ZipFile(jar, "w") as z:
            for name, code in dict(compiler.getBytecodes()).items():
                z.writestr(name.replace(".", "/") + ".class", bytes(code))
        spark.sparkContext._jsc.sc().addJar(put_file(new_folder(spark, "coder"), "coder", jar.getvalue(), ".jar"))
        _loaders.clear()
        _loaders[app] = compiler.getClassLoader()
    return _loaders[app]


def _instance(spark: SparkSession, kind: str):
    return _loader(spark).loadClass(f"{_NAME}${kind}").getDeclaredConstructors()[0].newInstance(spark.sparkContext._gateway.new_array(spark._jvm.Object, 0))


def _function(spark: SparkSession, kind: str, column: Column) -> Column:
    name = f"tidelog_ids_{kind.lower()}"
    spark._jsparkSession.udf().register(name, _instance(spark, kind), spark._jvm.org.apache.spark.sql.types.DataTypes.BinaryType)
    return F.call_udf(name, column)


def encoded(spark: SparkSession, ids: Column) -> Column:
    """Coded blocks of a binary column of ids (little-endian 16-bit)."""
    return _function(spark, "Encode", ids)


def decoded(spark: SparkSession, blocks: Column) -> Column:
    """The ids of coded blocks; fails on a block that its checksum doesn't fit."""
    return _function(spark, "Decode", blocks)


def packed(ids: np.ndarray) -> bytes:
    if len(ids) and int(ids.max()) >= TOTAL:
        raise ValueError("ids must be below 65536")
    return ids.astype("<u2").tobytes()


def encode(spark: SparkSession, ids: np.ndarray) -> bytes:
    """Coded blocks, by the driver's JVM."""
    return bytes(_instance(spark, "Encode").call(bytearray(packed(ids))))


def decode(spark: SparkSession, blocks: bytes) -> np.ndarray:
    from py4j.protocol import Py4JError
    from pyspark.errors import PySparkException

    try:
        return np.frombuffer(bytes(_instance(spark, "Decode").call(bytearray(blocks))), "<u2")
    except (Py4JError, PySparkException) as e:
        raise ValueError(f"a block is damaged: {e}") from None
