"""Whole product calls: from a request's raw parameters to page, meta and tag, through snapshots and the command line."""
import datetime as dt
import os
import uuid

import pytest
from pyspark.sql import functions as F

from stockboard.operators import contracts as K
from stockboard.operators import filters as FL
from stockboard.plans import products as P
from stockboard.session import ensure_checkpoint_dir
from stockboard.sources import snapshots as SN
from stockboard.sources import views as V

SF = "/root/testdata/sf0.001"
NOW = dt.datetime(2026, 7, 3, 9, 30)


def new_root(spark, name):
    return os.path.join(ensure_checkpoint_dir(spark), f"test-{name}", uuid.uuid4().hex)


def inputs(spark, name):
    return ([V.suppliers(spark, SF), V.deliveries(spark, SF)] if name == "supplier-risk" else [V.materials(spark, SF)])


def call(spark, root, name, major, raw, at=NOW):
    options = {"key": "supplier_key"} if name == "supplier-risk" else {}
    return P.cached_product(spark, root, name, major, *inputs(spark, name), raw=raw, now=at, **options)


CALLS = [("material-overview", 1, {"status": "Aktiv"}), ("material-overview", 2, {"status": ["Aktiv", "Obsolet"]}),
         ("supplier-risk", 1, {"seit": "1998-01-01", "toleranz_tage": "2"}), ("werk-auslastung", 1, {})]


@pytest.mark.parametrize("name, major, raw", CALLS)
def test_pages_follow_the_products_order_and_meta_counts_all(spark, name, major, raw):
    root = new_root(spark, "pages")
    product = P.find_product(name, major)
    everything = [tuple(r) for r in P.run_product(name, major, *inputs(spark, name),
                                                  params=P.parse_request(name, major, raw)[0],
                                                  **({"key": "supplier_key"} if name == "supplier-risk" else {})).collect()]
    first = call(spark, root, name, major, {**raw, "limit": 4, "offset": 0})
    second = call(spark, root, name, major, {**raw, "limit": 4, "offset": 4})
    assert [tuple(r) for r in first.data.collect()] + [tuple(r) for r in second.data.collect()] == everything[:8]
    a, b = first.meta.first(), second.meta.first()
    assert (a.cache, b.cache) == ("miss", "hit")                     # the page is cut from one snapshot
    assert a.total_count == b.total_count == len(everything) and a.row_count == min(4, len(everything))
    assert (a.product, a.version, a.source) == (name, product.version, "+".join(sorted(product.sources)))
    assert (a.deprecated, a.sunset) == (product.deprecated, product.sunset)
    key, falling = product.order[0]
    shown = [r[key] for r in first.data.collect() if r[key] is not None]
    assert shown == sorted(shown, reverse=falling)


def test_tags_follow_the_content_alone(spark):
    root = new_root(spark, "tags")
    raw = {"status": "Gesperrt", "limit": 6}
    tags = [call(spark, root, "material-overview", 2, r, at).tag.first()
            for r, at in ((raw, NOW), (raw, NOW + dt.timedelta(hours=5)), ({**raw, "offset": 1}, NOW))]
    assert tags[0] == tags[1] != tags[2]


def test_parameters_make_the_key_and_lifetime_ends_it(spark):
    root, p = new_root(spark, "life"), P.find_product("supplier-risk", 1)

    def state(raw, seconds):
        return call(spark, root, "supplier-risk", 1, raw, NOW + dt.timedelta(seconds=seconds)).meta.first().cache
    assert [state({"seit": "1998-01-01"}, 0), state({"seit": "1998-01-01", "limit": 3}, p.cache_ttl),
            state({"seit": "1998-01-02"}, 1), state({"seit": "1998-01-01"}, p.cache_ttl + 1)] == \
        ["miss", "hit", "miss", "miss"]
    assert P.request_key(p, P.RiskParams()) != P.request_key(p, P.RiskParams(toleranz_tage=1))


def test_changed_mappings_end_the_material_snapshots(spark):
    root = new_root(spark, "mappings")
    call(spark, root, "material-overview", 2, {"limit": 1})
    call(spark, root, "material-overview", 1, {"limit": 1})
    call(spark, root, "werk-auslastung", 1, {"limit": 1})
    schema = "material_nr string, ziel_warengruppe string, geaendert_am int, version int"
    before = spark.createDataFrame([("M1", "A", 1, 1), ("M2", "B", 1, 1)], schema)
    changes = spark.createDataFrame([("M1", "C", 2, 1), ("M3", "", 2, 1), (None, "D", 2, 1)], schema)
    table, ended = P.change_mappings(spark, root, NOW + dt.timedelta(seconds=5), changes, before)
    assert ended == 2 and sorted(tuple(r) for r in table.collect()) == [("M1", "C", 2, 1), ("M2", "B", 1, 1)]
    again = spark.createDataFrame([("M2", "E", 3, 1)], schema)                # over the stored version
    table, ended = P.change_mappings(spark, root, NOW + dt.timedelta(seconds=5), again)
    assert ended == 0 and sorted(tuple(r) for r in table.collect()) == [("M1", "C", 2, 1), ("M2", "E", 3, 1)]
    later = NOW + dt.timedelta(seconds=6)
    assert call(spark, root, "material-overview", 2, {"limit": 1}, later).meta.first().cache == "miss"
    assert call(spark, root, "werk-auslastung", 1, {"limit": 1}, later).meta.first().cache == "hit"


@pytest.mark.parametrize("name, major, raw", [
    ("material-overview", 2, {"stauts": "Aktiv"}), ("material-overview", 2, {"limit": 0}),
    ("material-overview", 2, {"limit": FL.MAX_LIMIT + 1}), ("material-overview", 2, {"offset": -1}),
    ("material-overview", 2, {"min_bestandswert": "-1"}), ("material-overview", 1, {"werk_id": "W-1"}),
    ("supplier-risk", 1, {"toleranz_tage": 31}), ("supplier-risk", 1, {"seit": "gestern"}),
    ("werk-auslastung", 1, {"min_materialien": -2})])
def test_requests_that_are_refused(name, major, raw):
    with pytest.raises(ValueError):
        P.parse_request(name, major, raw)


def test_requests_are_typed():
    params, limit, offset = P.parse_request("material-overview", 2, {"werk_id": "W-3", "ohne_klassifizierung": "on",
                                                                     "min_bestandswert": "2.5", "offset": "7"})
    assert params == P.MaterialParams(werk=("W-3",), ohne_klassifizierung=True, min_bestandswert=2.5)
    assert (limit, offset) == (1000, 7)
    assert P.parse_request("supplier-risk", 1, {"seit": dt.date(2020, 2, 2)})[0].seit == dt.date(2020, 2, 2)
    with pytest.raises(KeyError):
        P.parse_request("material-overview", 7, {})


def test_product_without_lifetime_is_never_stored(spark):
    root = new_root(spark, "bypass")
    assert SN.get_or_build(spark, root, "k", "p", NOW, 0, lambda: spark.range(2))[1] == "bypass"
    assert SN.valid_snapshots(spark, root, NOW).count() == 0


def test_table_view_has_its_columns_and_whole_stock(spark):
    from stockboard.sources import scans as S
    flat = S.scan_materials_flat(V.materials(spark, SF).withColumn("bestand", F.col("bestand").cast("double")))
    assert tuple(flat.columns) == S.FLAT_COLUMNS and dict(flat.dtypes)["bestand"] == "bigint"


def run_main(*args):
    from stockboard.__main__ import main
    return main(list(args))


def test_command_line_pages(spark):
    out = new_root(spark, "cli")
    assert run_main("product", "supplier-risk", "--sf-dir", SF, "--param", "seit=1998-01-01", "--param", "limit=2",
                    "--param", "offset=1", "--out", out) == 0
    want = P.run_product("supplier-risk", None, V.suppliers(spark, SF), V.deliveries(spark, SF),
                         params=P.RiskParams(seit=dt.date(1998, 1, 1))).collect()[1:3]
    got = spark.read.parquet(out).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_command_line_json_query_and_list(spark, capsys):
    out = new_root(spark, "cli")
    assert run_main("product", "werk-auslastung", "--sf-dir", SF, "--format", "json", "--out", f"{out}/p") == 0
    assert {"werk_id", "bestand_gesamt"} <= set(spark.read.json(f"{out}/p").columns)
    assert run_main("query", "count_status", "--sf-dir", SF, "--out", f"{out}/q") == 0
    assert sum(spark.read.parquet(f"{out}/q").first()) == 200
    capsys.readouterr()
    assert run_main("list") == 0
    listing = capsys.readouterr().out
    assert "product material-overview v1 (deprecated)" in listing and "query plant_load" in listing
    with pytest.raises(SystemExit):
        run_main("product", "no-such-product", "--sf-dir", SF)


def test_stored_entities_feed_the_command_line(spark):
    root = new_root(spark, "entities")
    V.materials(spark, SF).write.parquet(f"{root}/m")
    assert run_main("product", "material-overview", "--materials", f"{root}/m", "--param", "status=Gesperrt",
                    "--out", f"{root}/out") == 0
    got = spark.read.parquet(f"{root}/out")
    assert {r.status for r in got.collect()} == {"Gesperrt"} and got.columns == K.MATERIAL_V2.names
