"""Who may see what: grants from token claims, scopes and the namespace filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .catalog import in_namespace, live


def split_words(value: Column, separators: str = r"\s+") -> Column:
    return F.filter(F.split(value, separators), lambda w: w != "")


def parse_scopes(value: Column) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(split_words(value), F.array().cast("array<string>"))))


def parse_namespaces(value: Column) -> Column:
    """Names of a comma- or space-separated list; just ``*`` once a star is among them."""
    names = F.array_sort(F.array_distinct(split_words(value, r"[,\s]+")))
    return F.when(F.array_contains(names, "*"), F.array(F.lit("*"))).otherwise(names)


def contexts_from_claims(
    claims: DataFrame,
    default_tenant: str | None = None,
    default_namespaces: str | None = None,
    principal_claim: str = "sub",
    tenant_claim: str = "tenant_id",
    scopes_claim: str = "scope",
    namespaces_claim: str = "namespaces",
) -> DataFrame:
    """One row per claim set: tenant, principal, scopes, namespaces and, when the
    claims cannot be used, ``rejected``. An absent namespace claim grants nothing."""
    text = dict(claims.dtypes)

    def as_list(name: str, parse) -> Column:
        if name not in text:
            return F.lit(None).cast("array<string>")
        if text[name].startswith("array"):
            value = F.array_sort(F.array_distinct(F.col(name)))
            starred = F.array_contains(value, "*")
            if name == namespaces_claim:
                value = F.when(starred, F.array(F.lit("*"))).otherwise(value)
            return value
        return parse(F.col(name))

    def filled(name: str) -> Column:
        if name not in text:
            return F.lit(None).cast("string")
        return F.nullif(F.col(name).cast("string"), F.lit(""))

    empty = F.array().cast("array<string>")
    fallback = parse_namespaces(F.lit(default_namespaces)) if default_namespaces else empty
    tenant = F.coalesce(filled(tenant_claim), F.lit(default_tenant))
    principal = F.coalesce(filled(principal_claim), filled("sub"))
    return claims.select(
        tenant.alias("tenant_id"),
        principal.alias("principal_id"),
        F.coalesce(as_list(scopes_claim, parse_scopes), empty).alias("scopes"),
        F.coalesce(as_list(namespaces_claim, parse_namespaces), fallback).alias("namespaces"),
        F.when(principal.isNull(), "no_principal")
        .when(tenant.isNull(), "no_tenant")
        .alias("rejected"),
    )


def grants(contexts: DataFrame) -> DataFrame:
    """Usable contexts as rows (tenant, principal, namespace); '*' is tenant-wide."""
    usable = contexts.where(F.col("rejected").isNull())
    return tx.explode_once(
        usable, ["tenant_id", "principal_id"], F.col("namespaces"), "namespace"
    ).distinct()


def has_scopes(held: Column, required: list[str]) -> Column:
    needed = F.array(*(F.lit(s) for s in required)).cast("array<string>")
    return F.size(F.array_except(needed, held)) == 0


def visible_namespaces(entries: DataFrame, granted: DataFrame) -> DataFrame:
    """Per principal, the namespaces with live rows it may read, with their sizes.

    Entries shrink to one row per namespace before they meet the grants, so no
    pair of principal and document is ever built.
    """
    present = (
        live(entries)
        .groupBy("tenant_id", "namespace")
        .agg(F.count("*").alias("documents"), F.sum("size").alias("bytes"))
    )
    named = granted.where("namespace <> '*'").join(present, ["tenant_id", "namespace"])
    wide = (
        granted.where("namespace = '*'")
        .drop("namespace")
        .join(present, "tenant_id")
        .select(named.columns)
    )
    return named.union(wide)


def visible_entries(
    entries: DataFrame, granted: DataFrame, tenant_id: str, principal_id: str
) -> DataFrame:
    """Live rows one principal may read; an ungranted namespace looks empty."""
    mine = granted.where(
        (F.col("tenant_id") == tenant_id) & (F.col("principal_id") == principal_id)
    )
    named = mine.where("namespace <> '*'").select("namespace").distinct()
    star = mine.where("namespace = '*'").select("tenant_id").distinct()
    rows = in_namespace(live(entries), tenant_id)
    allowed = named.select("namespace", F.lit(True).alias("_named"))
    tenant_wide = star.select("tenant_id", F.lit(True).alias("_star"))
    return (
        rows.join(allowed, "namespace", "left")
        .join(tenant_wide, "tenant_id", "left")
        .where(F.col("_named") | F.col("_star"))
        .select(rows.columns)
    )
