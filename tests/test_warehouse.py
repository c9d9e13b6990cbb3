"""The materialised star equals the lazy adapter, table by table."""

from __future__ import annotations

from tests.paths import SF_SMALL
from starcart.plans.warehouse import warehouse_star
from starcart.sources.driver import driver_star


def test_warehouse_equals_adapter(spark):
    built = warehouse_star(spark, SF_SMALL).tables()
    lazy = driver_star(spark, SF_SMALL).tables()
    assert built.keys() == lazy.keys()
    for name in lazy:
        a, b = built[name], lazy[name].select(*built[name].columns)
        assert a.schema.simpleString() == b.schema.simpleString(), name
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, name


def test_warehouse_is_built_once_per_application(spark):
    first = warehouse_star(spark, SF_SMALL)
    second = warehouse_star(spark, SF_SMALL)
    assert first.origin == second.origin and first.origin is not None
