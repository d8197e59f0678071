"""JSON configuration files as expressions over a parsed variant."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from forgelens import schemas

OBJECT = "map<string,variant>"
# column, path of the scalar; fixed by the file formats
_TSCONFIG_TEXTS = (
    ("extends", "$.extends"),
    ("module", "$.compilerOptions.module"),
    ("target", "$.compilerOptions.target"),
    ("module_resolution", "$.compilerOptions.moduleResolution"),
    ("jsx", "$.compilerOptions.jsx"),
)


def parsed(content: Column) -> Column:
    """JSON with comments and commas before a closing bracket; null when it cannot be read.

    Comment marks inside strings count too.
    """
    bare = F.regexp_replace(F.coalesce(content, F.lit("")), r"/(?:/[^\n]*|\*(?:[^*]|\*(?!/))*+\*/)", "")
    return F.try_parse_json(F.regexp_replace(bare, r",(?=\s*[\]}])", ""))


def _of(doc: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(doc, path, kind)


def _entries(value: Column) -> Column:
    return F.coalesce(F.cardinality(value), F.lit(0)).cast("bigint")


def _filled(doc: Column, path: str) -> Column:
    """Whether there is a value that is not empty, zero or false."""
    return F.coalesce(
        _of(doc, path, OBJECT).isNotNull() & (_entries(_of(doc, path, OBJECT)) > 0),
        F.lit(False),
    ) | F.coalesce(_entries(_of(doc, path, "array<variant>")) > 0, F.lit(False)) | F.coalesce(
        ~_of(doc, path, "string").isin("", "false", "0", "{}", "[]"), F.lit(False)
    )


def _rule_count(doc: Column) -> Column:
    groups = F.map_values(_of(doc, "$.linter.rules", OBJECT))
    grouped = F.aggregate(
        groups, F.lit(0).cast("bigint"), lambda total, group: total + _entries(F.try_variant_get(group, "$", OBJECT))
    )
    own = _of(doc, "$.rules", OBJECT)
    return F.when(own.isNotNull(), _entries(own)).otherwise(F.coalesce(grouped, F.lit(0).cast("bigint")))


def columns(doc: Column) -> dict[str, dict[str, Column]]:
    """By kind: column name to value."""
    tasks = F.coalesce(
        F.when(_filled(doc, "$.tasks"), _of(doc, "$.tasks", OBJECT)), _of(doc, "$.pipeline", OBJECT)
    )
    plugins = _of(doc, "$.plugins", "array<variant>")
    return {
        "tsconfig": {
            **{name: _of(doc, path, "string") for name, path in _TSCONFIG_TEXTS},
            "strict": F.when(
                F.schema_of_variant(F.coalesce(_of(doc, "$.compilerOptions.strict", "variant"), F.parse_json(F.lit("0")))) == "BOOLEAN",
                _of(doc, "$.compilerOptions.strict", "boolean"),
            ),
            "paths_configured": _filled(doc, "$.compilerOptions.paths"),
        },
        "turbo": {"task_count": _entries(tasks), "uses_remote_cache": _filled(doc, "$.remoteCache")},
        "nx": {
            "plugins": F.coalesce(
                F.transform(plugins, lambda plugin: F.try_variant_get(plugin, "$", "string")),
                F.array().cast("array<string>"),
            ),
            "plugin_count": _entries(plugins),
            "named_inputs": F.coalesce(
                F.array_sort(F.map_keys(_of(doc, "$.namedInputs", OBJECT))), F.array().cast("array<string>")
            ),
        },
        "linter": {
            "top_level_keys": F.coalesce(
                F.array_sort(F.map_keys(_of(doc, "$", OBJECT))), F.array().cast("array<string>")
            ),
            "rule_count": _rule_count(doc),
        },
    }


def row(kind: Column, doc: Column) -> list[Column]:
    """The contract's columns after repo and path, for rows of JSON kinds.

    A linter file that cannot be read has no keys and no rules; of the other kinds it is an error, and so is
    anything but an object where tasks or plugins are expected.
    """
    by_kind = columns(doc)
    usable = F.when(kind == "linter", F.lit(True)).when(kind == "tsconfig", doc.isNotNull())
    usable = usable.otherwise(_of(doc, "$", OBJECT).isNotNull())
    out = []
    for field in schemas.CONFIG.fields[2:]:
        value = F.lit(None)
        for name, found in by_kind.items():
            if field.name in found:
                value = F.when(usable & (kind == name), found[field.name]).otherwise(value)
        if field.name == "kind":
            value = F.when(usable, kind).otherwise("parse_error")
        elif field.name == "error":
            value = F.when(~usable, "not JSON")
        out.append(value.cast(field.dataType).alias(field.name))
    return out
