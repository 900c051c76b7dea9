"""Java classes of this package: compiled on the driver, and sent to the executors as a jar."""

from __future__ import annotations

import hashlib
import os
import pkgutil
import subprocess
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOADERS: dict[tuple[str, str], object] = {}


def _compiled(spark: SparkSession, name: str, source: bytes, folder: str) -> dict[str, bytes]:
    """Bytecode by class. A JDK's compiler makes faster code than the one that Spark itself uses for its plans, which is there anywhere."""
    jvm = spark._jvm
    javac = os.path.join(jvm.java.lang.System.getProperty("java.home"), "bin", "javac")
    if os.path.exists(javac):
        path, out = os.path.join(folder, f"{name}.java"), os.path.join(folder, "sediment")
        with open(path, "wb") as f:
            f.write(source)
        args = ["-nowarn", "-Xlint:none", "-proc:none", "--release", "17", "-cp", jvm.java.lang.System.getProperty("java.class.path"), "-d", folder, path]
        subprocess.run([javac, *args], check=True, capture_output=True)
        return {f"sediment.{x.removesuffix('.class')}": Path(out, x).read_bytes() for x in os.listdir(out)}
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
    compiler.cook(source.decode())
    return {entry.getKey(): entry.getValue() for entry in compiler.getBytecodes().entrySet()}


def _loader(spark: SparkSession, name: str):
    """A class loader of <name>.java; compiled and sent once for each application."""
    context, jvm = spark.sparkContext, spark._jvm
    key = (context.applicationId, name)
    if key not in _LOADERS:
        source = pkgutil.get_data(__package__, f"{name}.java")
        with tempfile.TemporaryDirectory(prefix="sediment-") as folder:
            codes = _compiled(spark, name, source, folder)
        path = os.path.join(tempfile.mkdtemp(prefix="sediment-"), f"{name}-{hashlib.sha256(source).hexdigest()[:16]}.jar")
        with zipfile.ZipFile(path, "w") as jar:
            for entry, code in codes.items():
                jar.writestr(entry.replace(".", "/") + ".class", code)
        context._jsc.addJar(path)
        urls = context._gateway.new_array(jvm.java.net.URL, 1)
        urls[0] = jvm.java.io.File(path).toURI().toURL()
        _LOADERS[key] = jvm.java.net.URLClassLoader(urls, jvm.java.lang.Thread.currentThread().getContextClassLoader())
    return _LOADERS[key]


def ints(spark: SparkSession, values: tuple[int, ...]):
    out = spark.sparkContext._gateway.new_array(spark._jvm.int, len(values))
    for k, value in enumerate(values):
        out[k] = value
    return out


def _made(spark: SparkSession, name: str, inner: str, *args):
    """An object of an inner class of <name>.java."""
    given = spark.sparkContext._gateway.new_array(spark._jvm.java.lang.Object, len(args))
    for k, value in enumerate(args):
        given[k] = value
    return _loader(spark, name).loadClass(f"sediment.{name}${inner}").getConstructors()[0].newInstance(given)


def sent(spark: SparkSession, name: str, data: bytes):
    """A broadcast of bytes to the JVMs of the executors. The driver's JVM reads them from a file of its own machine: as text of a call they would take many times their size."""
    with tempfile.NamedTemporaryFile(prefix="sediment-") as f:
        f.write(data)
        f.flush()
        return _made(spark, name, "Sender").send(spark.sparkContext._jsc, f.name)


def map_rows(df: DataFrame, name: str, inner: str, schema: str, *args) -> DataFrame:
    """Rows of each part by way of a MapPartitionsFunction, an inner class of <name>.java, of these arguments."""
    spark = df.sparkSession
    encoder = spark._jvm.org.apache.spark.sql.Encoders.row(spark._jvm.org.apache.spark.sql.types.StructType.fromDDL(schema))
    return DataFrame(df._jdf.mapPartitions(_made(spark, name, inner, *args), encoder), spark)
