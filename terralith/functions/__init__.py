"""Spatial and similarity functions: JVM functions over WKB, registered in a session under their SQL names.

The geometry library ships with Spark. The source in `terralith/jvm` is compiled once with the JDK's compiler and added to the
session as a jar, which Spark's file server hands to all executors. Calls stay inside Catalyst plans, so they can stand in join
conditions, semi-joins and anti-joins, where Python functions cannot.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import subprocess
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "jvm", "Geo.java")
_B, _D, _S, _L = T.BinaryType(), T.DoubleType(), T.StringType(), T.BooleanType()
#: SQL name: class, result, and which arguments are doubles or ints (JVM functions get no implicit casts).
FUNCTIONS = {
    "st_intersects": ("Intersects", _L, {}), "st_touches": ("Touches", _L, {}), "st_contains": ("Contains", _L, {}), "st_within": ("Within", _L, {}), "st_crossing": ("Crossing", _L, {}), "st_relation": ("Relation", _S, {}),
    "st_area": ("Area", _D, {}), "st_xmin": ("XMin", _D, {}), "st_ymin": ("YMin", _D, {}), "st_xmax": ("XMax", _D, {}), "st_ymax": ("YMax", _D, {}), "st_box": ("Box", T.ArrayType(_D), {}),
    "st_intersection": ("Intersection", _B, {}), "st_difference": ("Difference", _B, {}), "st_buffer": ("Buffer", _B, {1: "double"}),
    "st_makeenvelope": ("MakeEnvelope", _B, {0: "double", 1: "double", 2: "double", 3: "double"}), "st_envelope": ("EnvelopeOf", _B, {}),
    "st_simplifypreservetopology": ("Simplify", _B, {1: "double"}), "st_union_list": ("UnionList", _B, {}), "st_geomfromtext": ("FromText", _B, {}), "st_astext": ("AsText", _S, {}),
    "st_asgeojson": ("AsGeoJson", _S, {}), "st_geojson_simplified": ("SimplifiedGeoJson", _S, {1: "double", 2: "int"}), "st_geomfromgeojson": ("FromGeoJson", _B, {}),
    "st_holds_point": ("HoldsPoint", _L, {1: "double", 2: "double"}), "st_cover": ("Cover", T.ArrayType(T.LongType()), {1: "int", 2: "int"}),
    "jaro_winkler_similarity": ("JaroWinkler", _D, {}),
}
#: Parts of a table that are united on their own before their unions are.
UNION_PARTS = 1024
_REGISTERED: set[str] = set()


def class_path(spark: SparkSession) -> str:
    """Where the running JVM itself has its classes from: its class path and the jar that holds the geometry library.

    The folder of the Python package says nothing about it: a session may come from another Spark installation.
    """
    jvm = spark._jvm
    paths = [p for p in jvm.java.lang.System.getProperty("java.class.path").split(os.pathsep) if p]
    for name in ("org.locationtech.jts.geom.Geometry", "org.apache.spark.sql.api.java.UDF1"):
        source = jvm.org.apache.spark.util.Utils.classForName(name, True, False).getProtectionDomain().getCodeSource()
        if source is not None:
            paths.insert(0, jvm.java.nio.file.Paths.get(source.getLocation().toURI()).toString())
    return os.pathsep.join(dict.fromkeys(paths))


def _compile(spark: SparkSession, folder: str) -> None:
    """Compiles the source into `folder`: in the running JVM if it carries a compiler, else with a JDK's `javac`."""
    jvm, libraries = spark._jvm, class_path(spark)
    options = ["-nowarn", "-encoding", "UTF-8", "-proc:none", "-cp", libraries, "-d", folder, SOURCE]
    tried = []
    compiler = jvm.javax.tools.ToolProvider.getSystemJavaCompiler()
    if compiler is not None:
        gateway = spark.sparkContext._gateway
        names = gateway.new_array(jvm.java.lang.String, len(options))
        for i, option in enumerate(options):
            names[i] = option
        said = jvm.java.io.ByteArrayOutputStream()
        # through the public interface: the class behind it lies in a module that does not export it
        tool = jvm.org.apache.spark.util.Utils.classForName("javax.tools.Tool", True, False)
        run = next(m for m in tool.getMethods() if m.getName() == "run")
        given = gateway.new_array(jvm.java.lang.Object, 4)
        given[1], given[2], given[3] = said, said, names
        if run.invoke(compiler, given) == 0:
            return
        tried.append("the compiler of the running JVM: " + said.toString()[-1500:])
    homes = [jvm.java.lang.System.getProperty("java.home"), os.environ.get("JAVA_HOME", "")]
    for path in dict.fromkeys([*(os.path.join(h, "bin", "javac") for h in homes if h), shutil.which("javac") or ""]):
        if os.path.isfile(path):
            done = subprocess.run([path, *options], capture_output=True, text=True)
            if not done.returncode:
                return
            tried.append(f"{path}: {done.stderr[-1500:]}")
    found = "\n".join(tried) or "no compiler in the running JVM and no javac beside it, in JAVA_HOME or on the PATH"
    raise RuntimeError(f"the spatial functions could not be compiled with class path {libraries[:1000]}; build the jar elsewhere and name it in TERRALITH_JAR. Tried: {found}")


def jar(spark: SparkSession) -> str:
    """The compiled functions' jar, built at first use; TERRALITH_JAR may name a jar that was built before."""
    if os.environ.get("TERRALITH_JAR"):
        return os.environ["TERRALITH_JAR"]
    with open(SOURCE, "rb") as file:
        mark = hashlib.sha256(file.read() + f"{spark.version}/{spark._jvm.java.lang.System.getProperty('java.specification.version')}".encode()).hexdigest()[:16]
    beside = os.path.join(os.path.dirname(SOURCE), "build")
    folder = beside if os.access(os.path.dirname(SOURCE), os.W_OK) else os.path.join(tempfile.gettempdir(), f"terralith-{os.getuid()}")
    os.makedirs(folder, exist_ok=True)
    target = os.path.join(folder, f"terralith-{mark}.jar")
    if not os.path.exists(target):
        with tempfile.TemporaryDirectory(dir=folder) as work:
            _compile(spark, work)
            part = os.path.join(work, "part.jar")
            with zipfile.ZipFile(part, "w") as archive:
                for base, _, files in os.walk(work):
                    for name in files:
                        if name.endswith(".class"):
                            archive.write(os.path.join(base, name), os.path.relpath(os.path.join(base, name), work))
            os.replace(part, target)
    return target


def register(spark: SparkSession) -> None:
    """Registers all functions in the session; does nothing if they are there."""
    mark = f"{spark.sparkContext.applicationId}/{spark._jsparkSession.sessionUUID()}"
    if mark in _REGISTERED:
        return
    spark.sql(f"ADD JAR '{jar(spark)}'")
    for name, (cls, result, _) in FUNCTIONS.items():
        spark.udf.registerJavaFunction(name, f"terralith.Geo${cls}", result)
    _REGISTERED.add(mark)


def call(name: str, *args) -> Column:
    """A registered function applied to columns, column names or numbers, with the casts that it needs."""
    casts = FUNCTIONS[name][2]
    columns = [F.col(a) if isinstance(a, str) else a if isinstance(a, Column) else F.lit(a) for a in args]
    return F.call_function(name, *[c.cast(casts[i]) if i in casts else c for i, c in enumerate(columns)])


def st_union_agg(column) -> Column:
    """Union of a group's geometries; null for a group without any. For groups of bounded size: all of it meets in one task (see union_of)."""
    return call("st_union_list", F.collect_list(column))


def union_of(rows: DataFrame, column: str = "geometry", out: str = "g") -> DataFrame:
    """One row with the union of all geometries of `rows`, however many: unions of parts, then of these; null without any."""
    part = rows.select(F.col(column).alias(out), F.pmod(F.xxhash64(column), F.lit(UNION_PARTS)).alias("_part"))
    for parts in (UNION_PARTS, int(UNION_PARTS**0.5)):
        part = part.groupBy(F.pmod("_part", F.lit(parts)).alias("_part")).agg(st_union_agg(out).alias(out))
    return part.agg(st_union_agg(out).alias(out))
