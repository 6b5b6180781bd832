import os
import sys
from datetime import datetime, timezone
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

# Python workers must find the parsers and connectors that tests define.
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT / "tests"), os.environ.get("PYTHONPATH", "")])

from pyspark.sql import SparkSession  # noqa: E402

from shelfmark.schemas import ENTRIES, PAGES  # noqa: E402

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("shelfmark-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def entry_row(path, tenant="dev", ns="handbook", **over):
    status = over.pop("status", "pending")
    pages = over.pop("page_count", None)
    version = over.pop("version", None)
    row = {
        "tenant_id": tenant,
        "namespace": ns,
        "path": path,
        "entry_id": f"ID-{tenant}-{ns}-{path}".replace("/", "_"),
        "size": 1,
        "etag": "e",
        "checksum": "sha-default",
        "content_type": "text/plain",
        "title": path,
        "metadata": {},
        "extraction": (status, None, pages, None, None),
        "source": None if version is None else ("c", path, version),
        "created_at": T0,
        "updated_at": T0,
        "deleted_at": None,
    }
    row.update(over)
    return tuple(row[f.name] for f in ENTRIES.fields)


@pytest.fixture(scope="session")
def make_entries(spark):
    def build(*rows):
        return spark.createDataFrame([entry_row(**r) if isinstance(r, dict) else entry_row(r) for r in rows], ENTRIES)

    return build


@pytest.fixture(scope="session")
def make_pages(spark):
    """Pages from {path: [text, ...]} under the ids that ``entry_row`` gives."""

    def build(texts, tenant="dev", ns="handbook"):
        rows = []
        for path, pages in texts.items():
            ident = f"ID-{tenant}-{ns}-{path}".replace("/", "_")
            rows += [(tenant, ns, ident, n, t, None) for n, t in enumerate(pages, 1)]
        return spark.createDataFrame(rows, PAGES)

    return build


@pytest.fixture(scope="session")
def make_corpus(make_entries, make_pages):
    """(entries, pages) of extracted documents {path: [text, ...]}; None is unreadable."""

    def build(texts, tenant="dev", ns="handbook"):
        rows = [
            dict(path=p, tenant=tenant, ns=ns, status="catalog_only")
            if pages is None
            else dict(path=p, tenant=tenant, ns=ns, status="extracted", page_count=len(pages))
            for p, pages in texts.items()
        ]
        return make_entries(*rows), make_pages({p: t for p, t in texts.items() if t}, tenant, ns)

    return build


def values(df, *columns):
    """Sorted row tuples of some columns."""
    rows = df.select(*columns).collect() if columns else df.collect()
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))
