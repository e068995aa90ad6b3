"""Named tables with INSERT, UPDATE and DELETE, as sets of Parquet files.

INSERT adds a set of files of the new rows alone; UPDATE and DELETE write the table anew. Each change is written first
and then the temporary view is pointed at it, so a reader sees the table before it or after it, and a failed change leaves
the table as it was. Unsigned types become the next wider signed ones.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The dialect's simple type names as Spark's.
TYPES = {
    "int8": "tinyint", "tinyint": "tinyint", "int16": "smallint", "smallint": "smallint", "int32": "int", "int": "int",
    "integer": "int", "int64": "bigint", "bigint": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint",
    "uint64": "decimal(20,0)", "float32": "float", "float": "float", "float64": "double", "double": "double",
    "string": "string", "text": "string", "varchar": "string", "uuid": "string", "bool": "boolean", "boolean": "boolean",
    "date": "date", "date32": "date", "datetime": "timestamp",
}


def spark_type(name: str) -> tuple[str, bool]:
    """A dialect type as Spark's DDL, and whether it is Nullable."""
    name = name.strip()
    m = re.fullmatch(r"(\w+)\((.*)\)", name, re.S)
    if not m:
        if name.lower() not in TYPES:
            raise ValueError(f"no such type: {name}")
        return TYPES[name.lower()], False
    outer, inner = m[1].lower(), m[2]
    parts = [x.strip() for x in re.findall(r"(?:[^,()]|\((?:[^()]|\([^()]*\))*\))+", inner)]
    if outer == "nullable":
        return spark_type(inner)[0], True
    if outer == "lowcardinality":
        return spark_type(inner)
    if outer == "array":
        return f"array<{spark_type(inner)[0]}>", False
    if outer == "map":
        return f"map<{spark_type(parts[0])[0]},{spark_type(parts[1])[0]}>", False
    if outer == "tuple":
        named = [re.fullmatch(r"(\w+)\s+(\S.*)", p, re.S) for p in parts]
        if all(named):
            return "struct<" + ",".join(f"{x[1]}:{spark_type(x[2])[0]}" for x in named) + ">", False
        return "struct<" + ",".join(f"_{i}:{spark_type(p)[0]}" for i, p in enumerate(parts, 1)) + ">", False
    if outer in ("datetime", "datetime64"):
        return "timestamp", False
    if outer in ("fixedstring", "enum8", "enum16"):
        return "string", False
    if outer == "decimal":
        return f"decimal({inner})", False
    if m := re.fullmatch(r"decimal(32|64|128|256)", outer):
        return f"decimal({ {'32': 9, '64': 18, '128': 38, '256': 38}[m[1]]},{inner.strip()})", False
    raise ValueError(f"no such type: {name}")


def _default(kind: T.DataType) -> Column:
    """0, '', false, 1970-01-01, or an empty array or map."""
    sql = kind.simpleString()
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.ArrayType):
        return F.array().cast(sql)
    if isinstance(kind, T.MapType):
        return F.create_map().cast(sql)
    if isinstance(kind, T.StructType):
        return F.struct(*[_default(f.dataType).alias(f.name) for f in kind.fields])
    return F.lit(0).cast(sql) if isinstance(kind, T.NumericType) else F.lit("1970-01-01").cast(sql)


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        """folder: a path that driver and executors share."""
        self.spark, self.folder = spark, folder.rstrip("/")
        self._schemas: dict[str, T.StructType] = {}
        self._defaults: dict[str, dict[str, Column]] = {}
        self._paths: dict[str, list[str]] = {}
        self._homes: dict[str, str] = {}

    def create(self, name: str, columns: Mapping[str, str], if_not_exists: bool = False) -> None:
        """columns: dialect types by name, each with DEFAULT and an SQL expression after it if wanted. A column that an
        INSERT leaves out takes its default; for null, one that isn't Nullable takes it, or else the type's own."""
        key = name.lower()
        if key in self._schemas:
            if if_not_exists:
                return
            raise ValueError(f"table exists: {name}")
        given = {c: re.split(r"\s+default\s+", t, maxsplit=1, flags=re.I) for c, t in columns.items()}
        kinds = {c: spark_type(t[0]) for c, t in given.items()}
        parsed = T.StructType.fromDDL(", ".join(f"`{c}` {sql}" for c, (sql, _) in kinds.items()))
        self._defaults[key] = {f.name: F.expr(given[f.name][1]).cast(f.dataType) for f in parsed.fields if len(given[f.name]) > 1}
        self._schemas[key] = T.StructType([T.StructField(f.name, f.dataType, kinds[f.name][1]) for f in parsed.fields])
        self._homes[key], self._paths[key] = f"{self.folder}/{key}-{uuid.uuid4().hex}", []
        self._publish(key, self.spark.createDataFrame([], parsed))

    def drop(self, name: str, if_exists: bool = False) -> None:
        """The table's files go with it."""
        key = name.lower()
        if key not in self._schemas:
            if if_exists:
                return
            raise KeyError(f"no such table: {name}")
        self.spark.catalog.dropTempView(key)
        home = self.spark._jvm.org.apache.hadoop.fs.Path(self._homes[key])
        home.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(home, True)
        for held in (self._schemas, self._defaults, self._paths, self._homes):
            del held[key]

    def names(self) -> list[str]:
        return sorted(self._schemas)

    def exists(self, name: str) -> bool:
        return name.lower() in self._schemas

    def table(self, name: str) -> DataFrame:
        if not self.exists(name):
            raise KeyError(f"no such table: {name}")
        return self.spark.table(name)

    def _publish(self, key: str, df: DataFrame, add: bool = False) -> None:
        path = f"{self._homes[key]}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        paths = [*self._paths[key], path] if add else [path]
        self.spark.read.schema(df.schema).parquet(*paths).createOrReplaceTempView(key)
        self._paths[key] = paths

    def _filled(self, key: str, df: DataFrame) -> DataFrame:
        given = {c.lower(): c for c in df.columns}
        if unknown := set(given) - {f.name.lower() for f in self._schemas[key].fields}:
            raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
        out = []
        for f in self._schemas[key].fields:
            own = self._defaults[key].get(f.name)
            missing = F.lit(None).cast(f.dataType) if own is None else own
            x = df[given[f.name.lower()]].cast(f.dataType) if f.name.lower() in given else missing
            out.append((x if f.nullable else F.coalesce(x, missing, _default(f.dataType))).alias(f.name))
        return df.select(*out)

    def insert(self, name: str, rows: DataFrame | Sequence[tuple], columns: Sequence[str] | None = None) -> None:
        """Rows of a DataFrame, or tuples; by position into columns (all, if not given); the rest takes defaults."""
        now = self.table(name)
        columns = list(columns or now.columns)
        if not isinstance(rows, DataFrame):
            kinds = {f.name.lower(): f.dataType for f in self._schemas[name.lower()].fields}
            rows = self.spark.createDataFrame(list(rows), T.StructType([T.StructField(c, kinds.get(c.lower(), T.StringType())) for c in columns]))
        self._publish(name.lower(), self._filled(name.lower(), rows.toDF(*columns)), add=True)

    def update(self, name: str, assignments: Mapping[str, Column], where: Column | None = None) -> int:
        """Every assignment sees the row as it was. Gives back the number of rows that meet where."""
        now = self.table(name)
        hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
        new = {c.lower(): x for c, x in assignments.items()}
        changed = [F.when(hit, new[c.lower()].cast(now.schema[c].dataType)).otherwise(now[c]).alias(c) if c.lower() in new else now[c] for c in now.columns]
        n = now.filter(hit).count()
        self._publish(name.lower(), self._filled(name.lower(), now.select(*changed)))
        return n

    def delete(self, name: str, where: Column | None = None) -> int:
        """Rows for which where is null stay. Gives back the number of rows that go."""
        now = self.table(name)
        hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
        n = now.filter(hit).count()
        self._publish(name.lower(), now.filter(~hit))
        return n
