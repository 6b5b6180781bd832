"""Object keys: admission tests, builders and the parser, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import limits
from .text import let

# Fixed values of the key scheme.
SLUG = r"\A[a-z0-9][a-z0-9_-]*\z"
OPAQUE_ID = r"\A[A-Za-z0-9_-]+\z"
RESERVED_SEGMENTS = ("", ".", "..", "tenants", "scratch", "derived")
PAGE_FILE = r"\A([0-9]{4})\.md(\.metadata\.json)?\z"
TREE_FILE = r"\A(.*)\.json\.zst\z"
MANIFEST_FILE = "manifest.json"

PARSED = T.StructType(
    [
        T.StructField("channel", T.StringType()),
        T.StructField("tenant_id", T.StringType()),
        T.StructField("namespace", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("principal_id", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("is_metadata", T.BooleanType()),
    ]
)


def valid_slug(value: Column) -> Column:
    return value.rlike(SLUG)


def valid_id(value: Column) -> Column:
    return value.rlike(OPAQUE_ID)


def valid_page(page: Column) -> Column:
    return page.between(0, limits.MAX_PAGE)


def valid_path(path: Column) -> Column:
    """A relative path without empty, dotted, reserved or underscore-led segments."""
    return F.forall(
        F.split(path, "/"),
        lambda s: ~s.isin(*RESERVED_SEGMENTS) & ~F.startswith(s, F.lit("_")),
    )


def originals_key(tenant: Column, namespace: Column, path: Column) -> Column:
    good = valid_slug(tenant) & valid_slug(namespace) & valid_path(path)
    return F.when(good, F.concat_ws("/", F.lit("tenants"), tenant, namespace, path))


def scratch_key(tenant: Column, principal: Column, path: Column) -> Column:
    good = valid_slug(tenant) & valid_slug(principal) & valid_path(path)
    return F.when(good, F.concat_ws("/", F.lit("scratch"), tenant, principal, path))


def derived_text_key(tenant: Column, namespace: Column, doc_id: Column, page: Column) -> Column:
    good = valid_slug(tenant) & valid_slug(namespace) & valid_id(doc_id) & valid_page(page)
    name = F.concat(F.lpad(page.cast("string"), limits.PAGE_DIGITS, "0"), F.lit(".md"))
    return F.when(good, F.concat_ws("/", F.lit("derived/text"), tenant, namespace, doc_id, name))


def derived_text_metadata_key(
    tenant: Column, namespace: Column, doc_id: Column, page: Column
) -> Column:
    return F.concat(derived_text_key(tenant, namespace, doc_id, page), F.lit(".metadata.json"))


def derived_meta_key(tenant: Column, namespace: Column, doc_id: Column) -> Column:
    good = valid_slug(tenant) & valid_slug(namespace) & valid_id(doc_id)
    return F.when(
        good, F.concat_ws("/", F.lit("derived/meta"), tenant, namespace, doc_id, F.lit(MANIFEST_FILE))
    )


def tree_key(tenant: Column, namespace: Column) -> Column:
    good = valid_slug(tenant) & valid_slug(namespace)
    return F.when(good, F.concat(F.lit("derived/tree/"), tenant, F.lit("/"), namespace, F.lit(".json.zst")))


def _record(channel: str, **fields: Column) -> Column:
    cells = []
    for field in PARSED.fields:
        if field.name == "channel":
            value = F.lit(channel)
        elif field.name == "is_metadata":
            value = fields.get("is_metadata", F.lit(False))
        else:
            value = fields.get(field.name, F.lit(None))
        cells.append(value.cast(field.dataType).alias(field.name))
    return F.struct(*cells)


def parse_key(key: Column) -> Column:
    """The parts of a conforming key as a struct, or null. Never guesses."""

    def read(seg: Column) -> Column:
        count = F.size(seg)
        at = lambda i: F.get(seg, F.lit(i))
        rest = F.array_join(F.slice(seg, F.lit(4), F.greatest(count - 3, F.lit(0))), "/")
        file_name = at(5)
        tree_name = F.regexp_extract(at(3), TREE_FILE, 1)
        owner = valid_slug(at(1)) & valid_slug(at(2)) & valid_path(rest)
        derived = (at(0) == "derived") & valid_slug(at(2))
        document = derived & (count == 6) & valid_slug(at(3)) & valid_id(at(4))
        return (
            F.when(
                derived & (at(1) == "tree") & (count == 4) & at(3).rlike(TREE_FILE)
                & valid_slug(tree_name),
                _record("derived_tree", tenant_id=at(2), namespace=tree_name),
            )
            .when(
                document & (at(1) == "text") & file_name.rlike(PAGE_FILE),
                _record(
                    "derived_text",
                    tenant_id=at(2),
                    namespace=at(3),
                    doc_id=at(4),
                    page=F.regexp_extract(file_name, PAGE_FILE, 1).try_cast("int"),
                    is_metadata=F.endswith(file_name, F.lit(".metadata.json")),
                ),
            )
            .when(
                document & (at(1) == "meta") & (file_name == MANIFEST_FILE),
                _record("derived_meta", tenant_id=at(2), namespace=at(3), doc_id=at(4)),
            )
            .when(
                (at(0) == "scratch") & (count >= 4) & owner,
                _record("scratch", tenant_id=at(1), principal_id=at(2), path=rest),
            )
            .when(
                (at(0) == "tenants") & (count >= 4) & owner,
                _record("original", tenant_id=at(1), namespace=at(2), path=rest),
            )
        )

    return let(F.split(key, "/"), read)


def is_indexable(key: Column) -> Column:
    """True only for originals; scratch and derived keys never enter the catalog."""
    return F.coalesce(parse_key(key)["channel"] == "original", F.lit(False))
