"""The kernels on whole texts in the JVM: `TextKernels.java`, compiled by the compiler that Spark has for its own code, as functions of a session."""

from __future__ import annotations

import os
import pkgutil
import tempfile
import zipfile

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .text import FOLD_GONE, FOLD_MANY, FOLD_ONE

_RETURNS = {"Pairs": "array<double>", "Errors": "array<bigint>", "Tau": "double", "Plain": "string", "Noise": "array<string>"}
_LOADERS: dict[str, object] = {}


def _source() -> str:
    quoted = lambda x: "".join(f"\\u{ord(c):04x}" if ord(c) > 126 else "\\" + c if c in "\"\\" else c for c in x)
    folds = {**FOLD_ONE, **FOLD_MANY, **dict.fromkeys(FOLD_GONE, "")}
    text = pkgutil.get_data(__package__, "TextKernels.java").decode()
    return text.replace('"@FOLDED@"', f'"{quoted("".join(folds))}"').replace("{@FOLDS@}", "{" + ", ".join(f'"{quoted(x)}"' for x in folds.values()) + "}")


def _loader(spark: SparkSession):
    """A loader of the compiled classes on the driver; they are compiled and shipped to the executors once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _LOADERS:
        jvm = spark.sparkContext._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader())
        compiler.cook(_source())
        path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="foliometer-")), "foliometer-kernels.jar")
        with zipfile.ZipFile(path, "w") as jar:
            for name, code in compiler.getBytecodes().items():
                jar.writestr(name.replace(".", "/") + ".class", bytes(code))
        spark.sql(f"ADD JAR '{path}'")
        _LOADERS[app] = compiler.getClassLoader()
    return _LOADERS[app]


def kernels(spark: SparkSession) -> None:
    """Makes the functions known to a session."""
    loader, known = _loader(spark), spark._jsparkSession.udf()
    for name, kind in _RETURNS.items():
        made = loader.loadClass(f"foliometer.TextKernels${name}").newInstance()
        known.register(f"foliometer_{name.lower()}", made, spark.sparkContext._jvm.org.apache.spark.sql.types.DataType.fromDDL(kind))


def call(name: str, *columns: Column) -> Column:
    return F.call_function(f"foliometer_{name}", *columns)
