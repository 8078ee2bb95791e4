"""Column predicates over a record, for raw JSON (VARIANT) and for typed rows alike.

*Present* means the key exists, even with a JSON null. *Covered* means there is a value and,
for strings, not the empty one. The two are kept apart on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _path(*keys: str) -> str:
    return "$" + "".join(f'["{key}"]' for key in keys)


class VariantRecord:
    """Accessors for a VARIANT column holding one JSON object per row."""

    def __init__(self, column: str = "v"):
        self.column = column

    def _get(self, keys: tuple[str, ...], as_type: str) -> Column:
        return F.expr(f"try_variant_get({self.column}, {_quote(_path(*keys))}, '{as_type}')")

    def _kind(self, *keys: str) -> Column:
        value = self._get(keys, "variant") if keys else F.col(self.column)
        return F.schema_of_variant(value)

    def present(self, *keys: str) -> Column:
        return self._get(keys, "variant").isNotNull()

    def is_mapping(self, *keys: str) -> Column:
        return F.coalesce(self._kind(*keys).startswith("OBJECT"), F.lit(False))

    def is_string(self, *keys: str) -> Column:
        return F.coalesce(self._kind(*keys) == "STRING", F.lit(False))

    def covered(self, *keys: str) -> Column:
        kind = self._kind(*keys)
        return F.coalesce(
            F.when(kind == "STRING", self._get(keys, "string") != "").otherwise(kind != "VOID"),
            F.lit(False),
        )

    def string(self, *keys: str) -> Column:
        """The value if it is a JSON string, else null."""
        return F.when(self.is_string(*keys), self._get(keys, "string"))

    def shown(self, *keys: str) -> Column:
        """The value as text, whatever its type; null for a missing key and for a JSON null."""
        return F.when(self.is_string(*keys), self._get(keys, "string")).when(
            self._kind(*keys) != "VOID", F.to_json(self._get(keys, "variant"))
        )

    def truthy(self, *keys: str) -> Column:
        kind = self._kind(*keys)
        return F.coalesce(
            F.when(kind == "STRING", self._get(keys, "string") != "")
            .when(kind == "BOOLEAN", self._get(keys, "boolean"))
            .when(kind.isin("VOID", "OBJECT<>", "ARRAY<VOID>"), F.lit(False))
            .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.lit(True))
            .otherwise(self._get(keys, "double") != 0),
            F.lit(False),
        )

    def task_type(self) -> Column:
        return F.coalesce(self.string("task"), self.string("task", "type"))

    def task_label(self) -> Column:
        return self.string("task", "label")

    def task_texts(self) -> Column:
        """All string values of a mapping task; empty for a plain task name."""
        return F.when(
            self.is_mapping("task"),
            F.expr(
                f"filter(transform(map_values(try_variant_get({self.column}, '$.task', 'map<string,variant>')),"
                " x -> if(schema_of_variant(x) = 'STRING', variant_get(x, '$', 'string'), null)),"
                " x -> x is not null)"
            ),
        ).otherwise(F.array().cast("array<string>"))


class TypedRecord:
    """Accessors for a DataFrame with real columns: presence is a property of the schema."""

    def __init__(self, df: DataFrame):
        self.schema = df.schema

    def _type(self, keys: tuple[str, ...]) -> T.DataType | None:
        current: T.DataType = self.schema
        for key in keys:
            if isinstance(current, T.StructType) and key in current.names:
                current = current[key].dataType
            elif isinstance(current, T.MapType):
                current = current.valueType
            else:
                return None
        return current

    def _col(self, keys: tuple[str, ...]) -> Column:
        column = F.col(f"`{keys[0]}`")
        for key in keys[1:]:
            column = column[key]
        return column

    def _in_map(self, keys: tuple[str, ...]) -> bool:
        return len(keys) > 1 and isinstance(self._type(keys[:-1]), T.MapType)

    def present(self, *keys: str) -> Column:
        if self._in_map(keys):
            return F.coalesce(F.map_contains_key(self._col(keys[:-1]), keys[-1]), F.lit(False))
        return F.lit(self._type(keys) is not None)

    def is_mapping(self, *keys: str) -> Column:
        if isinstance(self._type(keys), (T.StructType, T.MapType)):
            return self._col(keys).isNotNull()
        return F.lit(False)

    def is_string(self, *keys: str) -> Column:
        if isinstance(self._type(keys), T.StringType):
            return self._col(keys).isNotNull()
        return F.lit(False)

    def covered(self, *keys: str) -> Column:
        kind = self._type(keys)
        if kind is None:
            return F.lit(False)
        if isinstance(kind, T.StringType):
            return F.coalesce(self._col(keys) != "", F.lit(False))
        return self._col(keys).isNotNull()

    def string(self, *keys: str) -> Column:
        if isinstance(self._type(keys), T.StringType):
            return self._col(keys)
        return F.lit(None).cast("string")

    def shown(self, *keys: str) -> Column:
        kind = self._type(keys)
        if kind is None:
            return F.lit(None).cast("string")
        if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
            return F.to_json(self._col(keys))
        return self._col(keys).cast("string")

    def truthy(self, *keys: str) -> Column:
        kind = self._type(keys)
        if kind is None:
            return F.lit(False)
        column = self._col(keys)
        if isinstance(kind, T.StringType):
            test = column != ""
        elif isinstance(kind, T.BooleanType):
            test = column
        elif isinstance(kind, T.NumericType):
            test = column != 0
        elif isinstance(kind, (T.MapType, T.ArrayType)):
            test = F.size(column) > 0
        else:
            test = column.isNotNull()
        return F.coalesce(test, F.lit(False))

    def task_type(self) -> Column:
        if isinstance(self._type(("task",)), T.StringType):
            return self._col(("task",))
        return self.string("task", "type")

    def task_label(self) -> Column:
        return self.string("task", "label")

    def task_texts(self) -> Column:
        kind = self._type(("task",))
        task = self._col(("task",))
        if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.StringType):
            return F.coalesce(
                F.filter(F.map_values(task), lambda x: x.isNotNull()),
                F.array().cast("array<string>"),
            )
        if isinstance(kind, T.StructType):
            texts = [task[f.name] for f in kind.fields if isinstance(f.dataType, T.StringType)]
            if texts:
                return F.filter(F.array(*texts), lambda x: x.isNotNull())
        return F.array().cast("array<string>")
