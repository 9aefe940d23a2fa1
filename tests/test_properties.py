"""Property tests: operators vs plain-Python statements of the same rules,
on random small frames (nulls, blanks, case and rounding ties included)."""
import datetime as dt
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from stockboard.operators import filters as FL
from stockboard.plans import products as P

SETTINGS = settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))

STATUS = st.sampled_from(["Aktiv", "Gesperrt", "Obsolet", "Nicht geliefert"])
GROUP = st.sampled_from(["Rohstoffe", "", None, " ", "Verpackung"])
WERK = st.sampled_from(["Werk Köln", "Werk Berlin", None])
NAME = st.sampled_from(["Dichtring", "Schraube", "Ölfilter", None, "KABEL rot"])
ROW = st.tuples(STATUS, GROUP, WERK, NAME)
FLAT = ("material_nr string, bezeichnung string, warengruppe string, werk string, status string, "
        "einheit string, bestand long, geaendert string")


def py_filter(rows, state):
    out = []
    needle = (state.get("search") or "").strip().lower()
    for r in rows:
        nr, name, group, werk, status = r[0], r[1], r[2], r[3], r[4]
        if state.get("status") and status not in state["status"]:
            continue
        if state.get("werk") and werk not in state["werk"]:
            continue
        if state.get("warengruppe") and group not in state["warengruppe"]:
            continue
        if state.get("ohne_klass") and not (group is None or group == ""):
            continue
        if needle and not (needle in nr.lower() or (name is not None and needle in name.lower())):
            continue
        out.append(nr)
    return sorted(out)


@SETTINGS
@given(rows=st.lists(ROW, min_size=0, max_size=12),
       status=st.lists(STATUS, max_size=2), werk=st.lists(WERK.filter(bool), max_size=1),
       groups=st.lists(GROUP.filter(lambda g: g is not None), max_size=2),
       search=st.sampled_from(["", " mat-1", "RING", "öl", "x"]), ohne=st.booleans())
def test_apply_filters_matches_python(spark, rows, status, werk, groups, search, ohne):
    data = [(f"MAT-{i}", name, group, w, s, "ST", i, "01.01.2026")
            for i, (s, group, w, name) in enumerate(rows)]
    df = spark.createDataFrame(data, FLAT)
    state = {"status": status, "werk": werk, "warengruppe": groups, "search": search, "ohne_klass": ohne}
    got = sorted(r.material_nr for r in FL.apply_filters(df, state).collect())
    assert got == py_filter(data, state)


def spark_round(x, places):
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-places), rounding=ROUND_HALF_UP))


def py_risk(delays, complaints, tol):
    n = len(delays)
    mean = sum(delays) / n if n else 0.0
    punct = sum(1 for d in delays if d <= tol) / n if n else 1.0
    compl = sum(1 for c in complaints if c > 0) / n if n else 0.0
    score = spark_round(0.5 * (max(min(mean, 14.0), 0.0) / 14.0 * 100) + 0.3 * ((1 - punct) * 100)
                        + 0.2 * (compl * 100), 1) + 0.0
    cls = "hoch" if score >= 60 else "mittel" if score >= 30 else "niedrig"
    return n, spark_round(punct * 100, 1) + 0.0, spark_round(mean, 2) + 0.0, score, cls


SUP = "lieferant_id string, lieferant_name string, land string, anzahl_materialien long"
DEL = ("lieferant_id string, material_nr string, geliefert_am date, zugesagt_am date, menge int, "
       "reklamationen int")


@SETTINGS
@given(deliveries=st.lists(st.tuples(st.integers(-10, 30), st.integers(0, 2)), max_size=15),
       tol=st.integers(0, 5))
def test_risk_score_matches_python(spark, deliveries, tol):
    promised = dt.date(2026, 3, 1)
    sup = spark.createDataFrame([("L-1", "S", "DE", 1)], SUP)
    rows = [("L-1", "M", promised + dt.timedelta(days=d), promised, 1, c) for d, c in deliveries]
    dels = spark.createDataFrame(rows, DEL)
    r = P.supplier_risk(sup, dels, P.RiskParams(seit=dt.date(2026, 1, 1), toleranz_tage=tol,
                                                min_lieferungen=0)).first()
    want = py_risk([d for d, _ in deliveries], [c for _, c in deliveries], tol)
    assert (r.lieferungen, r.liefertreue_pct, r.mittlerer_verzug_tage, r.risiko_score, r.risiko_klasse) == want


RAW = ("material_nr string, bezeichnung string, warengruppe string, werk_id string, werk_name string, "
       "status string, einheit string, bestand long, preis double, geaendert string")


@SETTINGS
@given(rows=st.lists(st.tuples(NAME, GROUP, STATUS, st.one_of(st.none(), st.integers(0, 50)),
                               st.sampled_from([0.5, 2.25, 10.0, 99.99])), max_size=10),
       needle=st.sampled_from(["", "mat-1", "1 dicht", "schraube", " RING ", "kabel rot", "none"]),
       groups=st.lists(GROUP.filter(lambda g: g is not None), max_size=2), ohne=st.booleans(),
       minimum=st.one_of(st.none(), st.sampled_from([0.0, 10.0, 50.0])))
def test_material_overview_v2_matches_python(spark, rows, needle, groups, ohne, minimum):
    data = [(f"MAT-{i}", name, group, "W-1", "Werk", status, "ST", stock, price, "x")
            for i, (name, group, status, stock, price) in enumerate(rows)]
    df = spark.createDataFrame(data, RAW)
    params = P.MaterialParams(warengruppe=tuple(groups), ohne_klassifizierung=ohne, suche=needle,
                              min_bestandswert=minimum)
    got = sorted((r.material_nr, r.bestandswert) for r in P.material_overview_v2(df, params).collect())
    want = []
    n = needle.strip().lower()
    for nr, name, group, _w, _wn, _s, _e, stock, price, _g in data:
        group = group or None
        value = spark_round(float(stock) * price, 2) if stock is not None else None
        if groups and group not in groups:
            continue
        if ohne and group is not None:
            continue
        if minimum is not None and (value or 0) < minimum:
            continue
        if n and n not in f"{nr} {name or ''}".lower():
            continue
        want.append((nr, value))
    assert got == sorted(want)


@SETTINGS
@given(rows=st.lists(st.tuples(STATUS, GROUP), max_size=20))
def test_kpi_board_matches_python(spark, rows):
    from stockboard.operators.aggregates import kpi_board
    df = spark.createDataFrame(rows, "status string, warengruppe string")
    got = [r.value for r in kpi_board(df).orderBy("position").collect()]
    want = [sum(1 for s, _ in rows if s == k) for k in ("Aktiv", "Nicht geliefert", "Obsolet", "Gesperrt")]
    want.append(sum(1 for _, g in rows if g is None or g == ""))
    assert got == want


@SETTINGS
@given(rows=st.lists(st.tuples(st.integers(-5, 5), st.sampled_from(["a", "b", None, "ä"])), min_size=1, max_size=15),
       parts=st.integers(1, 5), seed=st.integers(0, 100))
def test_fingerprint_ignores_order_but_counts_duplicates(spark, rows, parts, seed):
    import random
    from stockboard.operators.aggregates import content_fingerprint
    shuffled = rows[:]
    random.Random(seed).shuffle(shuffled)
    a = content_fingerprint(spark.createDataFrame(rows, "n long, s string")).first()
    b = content_fingerprint(spark.createDataFrame(shuffled, "n long, s string").repartition(parts)).first()
    c = content_fingerprint(spark.createDataFrame(rows + rows[:1], "n long, s string")).first()
    assert a == b and c.n_rows == a.n_rows + 1 and c.fingerprint != a.fingerprint
