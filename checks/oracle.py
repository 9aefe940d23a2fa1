"""DuckDB SQL equivalents of the registered queries.

Each statement builds the same entity views as ``stockboard.sources.views``
as CTEs over the pre-registered test tables, then computes the query. The
text is DuckDB's dialect: ``datediff('day', start, end)``, ``strftime`` and
``printf``.
"""
from __future__ import annotations

# Fixed values, stated here on their own so that a wrong one in the package shows.
STATUSES = ("Aktiv", "Nicht geliefert", "Obsolet", "Gesperrt")
KPIS = (("aktiv", "Aktive Materialien", "#2e9e5b", '{"status":["Aktiv"],"ohne_klass":false}'),
        ("nicht_geliefert", "Nicht gelieferte Teile", "#ef6c00", '{"status":["Nicht geliefert"],"ohne_klass":false}'),
        ("obsolet", "Obsolete Materialien", "#6b7683", '{"status":["Obsolet"],"ohne_klass":false}'),
        ("gesperrt", "Gesperrte Materialien", "#d13b3b", '{"status":["Gesperrt"],"ohne_klass":false}'),
        ("ohne_klassifizierung", "Ohne Klassifizierung", "#6a4bc0", '{"status":[],"ohne_klass":true}'))
GROUPS = ("Betriebsstoffe", "Rohstoffe", "Fertigerzeugnisse", "Verpackung", "Ersatzteile", "Halbfabrikate", "")
GROUP_WEIGHTS = (18, 18, 18, 12, 12, 16, 6)
PLANTS = (("W-KOE", "Werk Koeln"), ("W-BER", "Werk Berlin"), ("W-MUC", "Werk Muenchen"), ("W-HAM", "Werk Hamburg"))
STATUS_WEIGHTS = (55, 18, 15, 12)
UNITS = ("M", "KG", "L", "PAK", "ST")
NAMES = ("Gewindestange M10", "Sensorhalter Typ B", "Dichtungsring NBR 25", "Aluminiumprofil 40x40",
         "Steckverbinder 4-pol", "Oelfilter Standard", "Edelstahlschraube M8x40", "Fuehrungsschiene 500mm",
         "Zahnriemen HTD-5M")
# (field, type, required, domain, minimum)
MATERIAL_RULES = (("material_nr", "varchar", True, None, None), ("bezeichnung", "varchar", False, None, None),
                  ("warengruppe", "varchar", False, None, None), ("werk", "varchar", False, None, None),
                  ("status", "varchar", False, STATUSES, None), ("einheit", "varchar", False, UNITS, None),
                  ("bestand", "bigint", False, None, None), ("geaendert", "varchar", False, None, None))
DELIVERY_RULES = (("lieferant_id", "varchar", True, None, None), ("material_nr", "varchar", True, None, None),
                  ("geliefert_am", "date", True, None, None), ("zugesagt_am", "date", True, None, None),
                  ("menge", "int", True, None, 1), ("reklamationen", "int", True, None, 0))
LABELS = {"material_nr": "MATERIAL-NR.", "bezeichnung": "BEZEICHNUNG", "warengruppe": "WARENGRUPPE", "werk": "WERK",
          "status": "STATUS", "einheit": "EINHEIT", "bestand": "BESTAND", "geaendert": "GEÄNDERT"}

MATERIALS = """
materials as (
  select concat('MAT-', cast(100777 + p_partkey * 13 as varchar)) as material_nr,
    p_name as bezeichnung,
    case when p_partkey % 17 = 0 then '' when p_partkey % 17 = 1 then null else p_type end as warengruppe,
    case when p_partkey % 19 = 0 then null else 'W-' || cast(n_nationkey as varchar) end as werk_id,
    case when p_partkey % 19 = 0 then null else n_name end as werk_name,
    case when p_size % 20 < 11 then 'Aktiv' when p_size % 20 < 15 then 'Nicht geliefert'
         when p_size % 20 < 18 then 'Obsolet' else 'Gesperrt' end as status,
    case p_partkey % 5 when 0 then 'M' when 1 then 'KG' when 2 then 'L' when 3 then 'PAK' else 'ST' end as einheit,
    case when p_partkey % 23 = 0 then null else cast(p_size * 100 as bigint) end as bestand,
    p_retailprice as preis,
    case when p_partkey % 2 = 0
         then strftime(date '2026-01-01' + cast(p_partkey % 240 as int), '%d.%m.%Y')
         else strftime(date '2026-01-01' + cast(p_partkey % 240 as int), '%Y-%m-%d') end as geaendert
  from part
  left join (select l_partkey as partkey, min(l_suppkey) as suppkey from lineitem group by l_partkey) e
         on e.partkey = p_partkey
  left join supplier on s_suppkey = e.suppkey
  left join nation on n_nationkey = s_nationkey
)"""

DELIVERIES = """
lieferungen as (
  select printf('L-%06d', l_suppkey) as lieferant_id,
    concat('MAT-', cast(100777 + l_partkey * 13 as varchar)) as material_nr,
    cast(l_shipdate as date) as geliefert_am,
    cast(l_shipdate as date) - cast(l_suppkey % 12 + l_linenumber % 5 - 4 as int) as zugesagt_am,
    cast(l_quantity as int) as menge,
    case when l_returnflag = 'R' then 1 else 0 end as reklamationen
  from lineitem
)"""

SUPPLIERS = """
suppliers as (
  select printf('L-%06d', s_suppkey) as lieferant_id, s_name as lieferant_name, n_name as land,
    count(*) as anzahl_materialien
  from supplier
  join (select distinct l_suppkey, l_partkey from lineitem) e on l_suppkey = s_suppkey
  left join nation on n_nationkey = s_nationkey
  group by s_suppkey, s_name, n_name
)"""

MAPPING_EVENTS = """
mapping_events as (
  select concat('MAT-', cast(100777 + l_partkey * 13 as varchar)) as material_nr,
    c_mktsegment as ziel_warengruppe, o_orderdate as geaendert_am, o_orderkey as version
  from lineitem join orders on l_orderkey = o_orderkey join customer on c_custkey = o_custkey
)"""

LATEST_MAPPING = """
latest_mapping as (
  select material_nr, ziel_warengruppe, geaendert_am, version from (
    select *, row_number() over (partition by material_nr
           order by geaendert_am desc, version desc, ziel_warengruppe desc) rn
    from mapping_events) t where rn = 1
)"""

FLAT = """
flat as (
  select material_nr, bezeichnung, warengruppe, werk_name as werk, status, einheit,
         try_cast(bestand as bigint) as bestand, geaendert
  from materials
)"""


def with_views(*ctes: str) -> str:
    return "with " + ",".join(ctes) + "\n"


V_ALL = with_views(MATERIALS, DELIVERIES, SUPPLIERS)
V_MAT = with_views(MATERIALS)
V_FLAT = with_views(MATERIALS, FLAT)
V_DEL = with_views(DELIVERIES)
V_SUP = with_views(SUPPLIERS)
DELIVERY_ORDER = """select row_number() over (order by lieferant_id, geliefert_am, material_nr, zugesagt_am, menge, reklamationen) as position, *
      from lieferungen where geliefert_am >= date '1998-01-01'"""


def risk_sql(seit: str = "1998-01-01", tol: int = 0, min_n: int = 1, classes: tuple = ()) -> str:
    where_cls = ""
    if classes:
        where_cls = " where risiko_klasse in (" + ", ".join(f"'{c}'" for c in classes) + ")"
    return V_ALL + f"""
, k as (
  select lieferant_id, count(*) as lieferungen,
    avg(datediff('day', zugesagt_am, geliefert_am)) as v,
    avg(cast(datediff('day', zugesagt_am, geliefert_am) <= {tol} as double)) as p,
    avg(cast(reklamationen > 0 as double)) as q
  from lieferungen where geliefert_am >= date '{seit}' group by lieferant_id
), j as (
  select s.lieferant_id, lieferant_name, land, anzahl_materialien,
    cast(coalesce(k.lieferungen, 0) as bigint) as lieferungen,
    coalesce(v, 0.0) as v, coalesce(p, 1.0) as p, coalesce(q, 0.0) as q
  from suppliers s left join k on s.lieferant_id = k.lieferant_id
), s as (
  select *, round(0.5 * (greatest(least(v, 14.0), 0.0) / 14.0 * 100)
                 + 0.3 * ((1 - p) * 100) + 0.2 * (q * 100), 1) + 0.0 as risiko_score
  from j where lieferungen >= {min_n}
), r as (
  select lieferant_id, lieferant_name, land, anzahl_materialien, lieferungen,
    round(p * 100, 1) + 0.0 as liefertreue_pct,
    round(v, 2) + 0.0 as mittlerer_verzug_tage,
    round(q * 100, 1) + 0.0 as reklamationsquote_pct,
    risiko_score,
    case when risiko_score >= 60 then 'hoch' when risiko_score >= 30 then 'mittel' else 'niedrig' end
      as risiko_klasse
  from s
)
select * from r{where_cls}"""



GRAPH = """
, nodes as (
  select 'Material:' || material_nr as node_id, 'Material' as label, bezeichnung as name, status, einheit, bestand,
         preis, geaendert, cast(null as varchar) as land
    from materials where material_nr is not null
  union all
  select 'Werk:' || werk_id, 'Werk', max(werk_name), null, null, null, null, null, null
    from materials where werk_id is not null group by werk_id
  union all
  select 'Warengruppe:' || warengruppe, 'Warengruppe', warengruppe, null, null, null, null, null, null
    from materials where warengruppe <> '' group by warengruppe
  union all
  select 'Lieferant:' || printf('L-%06d', s_suppkey), 'Lieferant', s_name, null, null, null, null, null, n_name
    from supplier left join nation on n_nationkey = s_nationkey
), edges as (
  select distinct * from (
    select 'LOCATED_IN' as rel, 'Material:' || material_nr as src, 'Werk:' || werk_id as dst
      from materials where werk_id is not null
    union all
    select 'HAS_WARENGRUPPE', 'Material:' || material_nr, 'Warengruppe:' || warengruppe
      from materials where warengruppe <> ''
    union all
    select 'SUPPLIES', 'Lieferant:' || printf('L-%06d', l_suppkey),
           'Material:' || concat('MAT-', cast(100777 + l_partkey * 13 as varchar))
      from (select distinct l_suppkey, l_partkey from lineitem) e
      where concat('MAT-', cast(100777 + l_partkey * 13 as varchar)) in (select material_nr from materials)
  ) u
)
"""
V_GRAPH = with_views(MATERIALS) + GRAPH
# Without the blocked materials, which carry the extra label.
V_GRAPH_LIVE = (with_views(MATERIALS.replace("materials as (", "all_materials as (", 1))
                + ", materials as (select * from all_materials where status <> 'Gesperrt')" + GRAPH)


def fingerprint_sql(columns: dict[str, str], source: str) -> str:
    """columns: name -> text expression."""
    names = "".join(f"{len(c)}:{c}" for c in columns)
    text = " || ".join([f"'{names}'", *[f"coalesce(length({e}) || ':' || {e}, '-')" for e in columns.values()]])
    lanes = [f"cast(coalesce(sum(cast('0x' || substr(h, {at}, 15) as bigint)), 0) as varchar)" for at in (1, 16)]
    return f"select count(*) as n_rows, {lanes[0]} || '-' || {lanes[1]} as fingerprint from (select sha256({text}) as h from {source}) f"


def _draw(name: str, *ids: str) -> str:
    parts = ", ".join(["'42'", f"'{name}'", *[f"cast({i} as varchar)" for i in ids]])
    return f"cast('0x' || substr(sha256(concat_ws(':', {parts})), 1, 15) as bigint)"


def _choice(d: str, values) -> str:
    whens = " ".join(f"when {i} then {_lit(v)}" for i, v in enumerate(values))
    return f"(case ({d}) % {len(values)} {whens} end)"


def _weighted(d: str, values, weights) -> str:
    bound, whens = 0, []
    for v, w in zip(values, weights):
        bound += w
        whens.append(f"when ({d}) % {sum(weights)} < {bound} then {_lit(v)}")
    return "(case " + " ".join(whens) + " end)"


def _lit(v) -> str:
    return f"'{v}'" if isinstance(v, str) else str(v)


def _uniform(d: str, lo: int, hi: int) -> str:
    return f"({lo} + ({d}) % {hi - lo + 1})"


GENERATE_MATERIALS = f"""
with ids as (select p_partkey - 1 as i from part)
select cast(i as bigint) as i,
  concat('MAT-', cast(100777 + i * 13 as varchar)) as material_nr,
  {_choice(_draw('name', 'i'), NAMES)} as bezeichnung,
  {_weighted(_draw('warengruppe', 'i'), GROUPS, GROUP_WEIGHTS)} as warengruppe,
  {_choice(_draw('werk', 'i') + ' % 4', [p[0] for p in PLANTS])} as werk_id,
  {_choice(_draw('werk', 'i') + ' % 4', [p[1] for p in PLANTS])} as werk_name,
  {_weighted(_draw('status', 'i'), STATUSES, STATUS_WEIGHTS)} as status,
  {_choice(_draw('einheit', 'i'), UNITS)} as einheit,
  cast({_uniform(_draw('bestand', 'i'), 300, 9800)} as bigint) as bestand,
  cast({_uniform(_draw('preis', 'i'), 50, 48000)} as double) / 100.0 as preis,
  printf('2026-%02d-%02d', cast({_uniform(_draw('monat', 'i'), 1, 8)} as int),
         cast({_uniform(_draw('tag', 'i'), 1, 28)} as int)) as geaendert
from ids
"""

_HUNDREDTHS = (f"({_choice(_draw('bias', 'lieferant_id'), (0, 2, 6, 1))} * 100 "
               f"+ {_uniform(_draw('verzug', 'lieferant_id', 'n'), -300, 300)})")
GENERATE_DELIVERIES = V_SUP + f"""
, series as (select lieferant_id, n from suppliers cross join range(0, {40}) t(n))
, d as (
  select lieferant_id,
    concat('MAT-', cast(100777 + (({_draw('material', 'lieferant_id', 'n')}) % (select count(*) from part)) * 13 as varchar))
      as material_nr,
    date '2026-01-01' + cast(n * 5 as int) as zugesagt_am,
    greatest(0, cast(floor(({_HUNDREDTHS} + 50) / 100.0) as int)) as verzug,
    cast({_uniform(_draw('menge', 'lieferant_id', 'n'), 10, 899)} as int) as menge,
    cast({_weighted(_draw('reklamationen', 'lieferant_id', 'n'), (0, 1, 2), (85, 12, 3))} as int)
      as reklamationen
  from series)
select lieferant_id, material_nr, zugesagt_am, zugesagt_am + verzug as geliefert_am, menge, reklamationen
from d
"""

V2_COLS = """material_nr, bezeichnung, nullif(warengruppe, '') as warengruppe, werk_id, werk_name, status,
  bestand, preis, round(cast(bestand as double) * preis, 2) as bestandswert, geaendert"""


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _kpi_board() -> str:
    selects = []
    for pos, (kid, label, color, flt) in enumerate(KPIS, start=1):
        selects.append(f"select cast({pos} as int) as position, '{kid}' as kpi_id, '{label}' as label, "
                       f"'{color}' as color, cast({kid} as bigint) as value, '{flt}' as filter from c")
    counts = ", ".join(f"count_if(status = '{s}') as {s.lower().replace(' ', '_')}" for s in STATUSES)
    return (V_FLAT + f", c as (select {counts}, count_if(warengruppe is null or warengruppe = '') "
            f"as ohne_klassifizierung from flat)\n" + "\nunion all\n".join(selects))


def _kpi_board_after_changes() -> str:
    """The changes made to the rows, then a recount."""
    after = V_FLAT + """, old as (select * from flat), after as (
      select material_nr, bezeichnung, case when status = 'Nicht geliefert' then coalesce(nullif(warengruppe, ''), 'Neu')
          else warengruppe end as warengruppe, werk, case when status = 'Nicht geliefert' then 'Aktiv' else status end as status,
        einheit, bestand, geaendert from old where status <> 'Gesperrt'
      union all
      select 'N-' || material_nr, bezeichnung, warengruppe, werk, 'Aktiv', einheit, bestand, geaendert from old
      where status = 'Obsolet')"""
    names = ("material_nr", "bezeichnung", "warengruppe", "werk", "status", "einheit", "bestand", "geaendert")
    tag = fingerprint_sql({c: f"cast({c} as varchar)" for c in names}, "after")
    tiles = _kpi_board()[len(V_FLAT):].replace("from flat)", "from after)", 1)
    tiles = tiles.replace(", c as (", f", tag as ({tag}), c as (", 1)
    for pos in range(1, len(KPIS) + 1):
        tiles = tiles.replace(f"select cast({pos} as int)", f"select tag.n_rows, tag.fingerprint, cast({pos} as int)")
    return after + tiles.replace(" from c", " from c, tag")


def _violations(rules, source: str) -> str:
    parts = []
    for name, kind, required, domain, minimum in rules:
        if required:
            parts.append((name, "required", f"{name} is null"))
        parts.append((name, "type", f"{name} is not null and try_cast({name} as {kind}) is null"))
        if domain:
            parts.append((name, "domain", f"{name} is not null and {name} not in {_in(domain)}"))
        if minimum is not None:
            parts.append((name, "range", f"{name} < {minimum}"))
    return "\nunion all\n".join(
        f"select cast({pos} as int) as pos, '{name}' as feld, '{rule}' as regel, "
        f"cast(count_if({test}) as bigint) as verstoesse from {source}" for pos, (name, rule, test) in enumerate(parts))


_N_PARTS = "(select count(distinct p_partkey) from part)"
# Floyd's sample: a fold over the last k indices, each wrapped as a list.
SAMPLE = f"""
with mats as (select dense_rank() over (order by p_partkey) - 1 as i from (select distinct p_partkey from part) p),
s as (select printf('L-%06d', s_suppkey) as lieferant_id from supplier),
k as (select lieferant_id, least(8, {_N_PARTS}) + ({_draw('k', 'lieferant_id')})
             % (least(30, {_N_PARTS}) - least(8, {_N_PARTS}) + 1) as k, {_N_PARTS} as n from s),
js as (select lieferant_id, list_transform(range(n - k, n), lambda j: [cast(j as bigint),
              cast(({_draw('pick', 'lieferant_id', 'j')}) % (j + 1) as bigint)]) as draws from k),
p as (select lieferant_id, unnest(list_reduce(draws, lambda acc, d:
        list_append(acc, case when list_contains(acc, d[2]) then d[1] else d[2] end), cast([] as bigint[]))) as i from js)
select lieferant_id, concat('MAT-', cast(100777 + p.i * 13 as varchar)) as material_nr from p join mats on mats.i = p.i
"""

_FLAT_ORDER = "material_nr, bezeichnung, warengruppe, werk, status, einheit, bestand, geaendert"
ORACLE: dict[str, str] = {
    # S
    "scan_materials": V_MAT + "select * from materials",
    "scan_materials_flat": V_FLAT + "select * from flat",
    "scan_supplier_links": V_SUP + "select * from suppliers",
    "scan_deliveries": V_DEL + "select * from lieferungen where geliefert_am >= date '1998-01-01'",
    "generate_materials": GENERATE_MATERIALS,
    "generate_deliveries": GENERATE_DELIVERIES,
    "graph_nodes": V_GRAPH + "select * from nodes",
    "graph_edges": V_GRAPH + "select * from edges",
    "purge_label": V_GRAPH + """select * from edges
      where src not in (select node_id from nodes where label = 'Werk')
        and dst not in (select node_id from nodes where label = 'Werk')""",
    "records_json": risk_sql(),
    "snapshot_roundtrip": risk_sql(),
    # P
    "material_overview_v1": V_MAT + """
      select material_nr, bezeichnung, nullif(warengruppe, '') as warengruppe, werk_name as werk, status,
             einheit, bestand, geaendert
      from materials
      where status in ('Aktiv', 'Obsolet') and werk_name in ('NATION_1', 'NATION_2', 'NATION_5')
        and contains(lower(material_nr || ' ' || coalesce(bezeichnung, '')), 'o')""",
    "material_overview_v2": V_MAT + f"""
      select * from (select {V2_COLS} from materials) v
      where status in ('Aktiv', 'Nicht geliefert') and werk_id in ('W-4', 'W-9', 'W-16')
        and coalesce(bestandswert, 0) >= 20000.0
        and contains(lower(material_nr || ' ' || coalesce(bezeichnung, '')), 'mat-10')""",
    "blank_to_null": V_MAT + "select material_nr, nullif(warengruppe, '') as warengruppe from materials",
    "lenient_cast": V_MAT + """select material_nr, try_cast(cast(bestand as varchar) as bigint) as bestand,
      try_cast(status as bigint) as status_zahl, try_cast(substr(material_nr, 5) as bigint) as nummer
      from materials""",
    "stock_value": V_MAT + """select material_nr, bestand, preis,
      round(cast(bestand as double) * preis, 2) as bestandswert from materials""",
    "delay_days": V_DEL + """select lieferant_id, material_nr, geliefert_am, zugesagt_am,
      cast(datediff('day', zugesagt_am, geliefert_am) as int) as verzug_tage from lieferungen""",
    "supplier_kpis_filled": V_ALL + """
      , k as (select lieferant_id, count(*) as lieferungen,
          avg(datediff('day', zugesagt_am, geliefert_am)) as mittlerer_verzug_tage,
          avg(cast(datediff('day', zugesagt_am, geliefert_am) <= 0 as double)) as puenktlich,
          avg(cast(reklamationen > 0 as double)) as reklamationsquote
        from lieferungen where geliefert_am >= date '1998-01-01' group by lieferant_id)
      select s.*, cast(coalesce(k.lieferungen, 0) as bigint) as lieferungen,
        coalesce(mittlerer_verzug_tage, 0.0) as mittlerer_verzug_tage, coalesce(puenktlich, 1.0) as puenktlich,
        coalesce(reklamationsquote, 0.0) as reklamationsquote
      from suppliers s left join k on s.lieferant_id = k.lieferant_id""",
    "risk_score": f"select lieferant_id, risiko_score from ({risk_sql(min_n=0)}) r",
    "risk_class_histogram": f"""select risiko_klasse, count(*) as lieferanten
      from ({risk_sql()}) r group by risiko_klasse""",
    "visible_columns": V_FLAT + "select material_nr, bezeichnung, status, bestand from flat",
    "label_columns": V_FLAT + "select " + ", ".join(f'{c} as "{l}"' for c, l in LABELS.items()) + " from flat",
    "format_thousands": V_MAT + """
      , p as (select werk_id, cast(sum(coalesce(bestand, 0)) as bigint) as bestand_gesamt
              from materials group by werk_id)
      select werk_id, bestand_gesamt, replace(format('{:,}', bestand_gesamt), ',', '.') as bestand_text from p""",
    "status_color": V_FLAT + """select material_nr, status, case status when 'Aktiv' then '#2e9e5b'
      when 'Nicht geliefert' then '#ef6c00' when 'Obsolet' then '#6b7683' when 'Gesperrt' then '#d13b3b' end
      as farbe from flat""",
    "normalize_change_date": V_MAT + """select material_nr, geaendert,
      cast(coalesce(try_strptime(geaendert, '%d.%m.%Y'), try_strptime(geaendert, '%Y-%m-%d')) as date)
      as geaendert_datum from materials""",
    # F
    "multiselect": V_FLAT + "select * from flat where status in ('Aktiv', 'Gesperrt') and werk in ('NATION_3', 'NATION_7')",
    "unclassified": V_FLAT + "select * from flat where warengruppe is null or warengruppe = ''",
    "search_any": V_FLAT + """select * from flat
      where contains(lower(material_nr), 'blue') or contains(lower(bezeichnung), 'blue')""",
    "search_joined": V_MAT + """select * from materials
      where contains(lower(material_nr || ' ' || coalesce(bezeichnung, '')), '7 red')""",
    "search_indexed": V_MAT + """select *, 'any:blue' as suche from materials
        where contains(lower(material_nr), 'blue') or contains(lower(bezeichnung), 'blue')
      union all select *, 'joined:7 red' from materials
        where contains(lower(material_nr || ' ' || coalesce(bezeichnung, '')), '7 red')
      union all select *, 'any:77' from materials
        where contains(lower(material_nr), '77') or contains(lower(bezeichnung), '77')""",
    "min_stock_value": V_MAT + f"select * from (select {V2_COLS} from materials) v where coalesce(bestandswert, 0) >= 50000.0",
    "supplier_risk_all": risk_sql(min_n=0),
    "supplier_risk_hoch": risk_sql(classes=("hoch",)),
    "apply_filters": V_FLAT + """select * from flat
      where status in ('Aktiv', 'Gesperrt') and werk in ('NATION_3', 'NATION_7', 'NATION_11')
        and (contains(lower(material_nr), 'red') or contains(lower(bezeichnung), 'red'))""",
    "apply_filters_empty": V_FLAT + "select * from flat",
    "column_filters": V_FLAT + """select * from flat
      where bestand >= 1000 and lower(status) = 'aktiv' and contains(lower(bezeichnung), 'gear')""",
    "kpi_drilldown": V_FLAT + "select * from flat where status in ('Nicht geliefert')",
    # J
    "supplier_kpis": V_ALL + """
      , k as (select lieferant_id, count(*) as lieferungen,
          avg(datediff('day', zugesagt_am, geliefert_am)) as mittlerer_verzug_tage,
          avg(cast(datediff('day', zugesagt_am, geliefert_am) <= 0 as double)) as puenktlich,
          avg(cast(reklamationen > 0 as double)) as reklamationsquote
        from lieferungen where geliefert_am >= date '1998-01-01' group by lieferant_id)
      select s.*, k.lieferungen, k.mittlerer_verzug_tage, k.puenktlich, k.reklamationsquote
      from suppliers s left join k on s.lieferant_id = k.lieferant_id""",
    "apply_mappings": with_views(MATERIALS, MAPPING_EVENTS, LATEST_MAPPING) + """
      select m.material_nr, bezeichnung, coalesce(l.ziel_warengruppe, m.warengruppe) as warengruppe, werk_id,
        werk_name, status, einheit, bestand, preis, geaendert
      from materials m left join latest_mapping l on m.material_nr = l.material_nr""",
    # A
    "count_status": V_FLAT + "select " + ", ".join(
        f"count_if(status = '{s}') as {s.lower().replace(' ', '_')}" for s in STATUSES) + " from flat",
    "count_unclassified": V_FLAT + "select count_if(warengruppe is null or warengruppe = '') as ohne_klassifizierung from flat",
    "kpi_board": _kpi_board(),
    "kpi_board_after_changes": _kpi_board_after_changes(),
    "delivery_kpis": V_DEL + """select lieferant_id, count(*) as lieferungen,
        avg(datediff('day', zugesagt_am, geliefert_am)) as mittlerer_verzug_tage,
        avg(cast(datediff('day', zugesagt_am, geliefert_am) <= 0 as double)) as puenktlich,
        avg(cast(reklamationen > 0 as double)) as reklamationsquote
      from lieferungen where geliefert_am >= date '1998-01-01' group by lieferant_id""",
    "delivery_kpis_tolerance": V_DEL + """select lieferant_id, count(*) as lieferungen,
        avg(datediff('day', zugesagt_am, geliefert_am)) as mittlerer_verzug_tage,
        avg(cast(datediff('day', zugesagt_am, geliefert_am) <= 3 as double)) as puenktlich,
        avg(cast(reklamationen > 0 as double)) as reklamationsquote
      from lieferungen where geliefert_am >= date '1998-01-01' group by lieferant_id""",
    "delivery_kpis_by_tolerance": V_DEL + """select lieferant_id, cast(t as int) as toleranz_tage, count(*) as lieferungen,
        avg(datediff('day', zugesagt_am, geliefert_am)) as mittlerer_verzug_tage,
        avg(cast(datediff('day', zugesagt_am, geliefert_am) <= t as double)) as puenktlich,
        avg(cast(reklamationen > 0 as double)) as reklamationsquote
      from lieferungen, range(31) tolerances(t) where geliefert_am >= date '1998-01-01' group by lieferant_id, t""",
    "plant_load": V_MAT + """select werk_id, min(werk_name) as werk_name, count(*) as materialien,
        cast(sum(coalesce(bestand, 0)) as bigint) as bestand_gesamt
      from materials group by werk_id having count(*) >= 0""",
    "delivery_summary": V_DEL + """select lieferant_id, count(*) as lieferungen,
        round(avg(datediff('day', zugesagt_am, geliefert_am)), 2) + 0.0 as mittlerer_verzug
      from lieferungen group by lieferant_id""",
    "nodes_per_label": V_GRAPH + "select label, count(*) as anzahl from nodes group by label",
    "record_counter": V_FLAT + """, c as (select count_if(status in ('Aktiv', 'Gesperrt')
          and werk in ('NATION_3', 'NATION_7', 'NATION_11')
          and (contains(lower(material_nr), 'red') or contains(lower(bezeichnung), 'red'))) as gefiltert,
        count(*) as gesamt from flat)
      select gefiltert, gesamt, cast(gefiltert as varchar) || ' / ' || cast(gesamt as varchar) || ' Datensätze'
        as anzeige from c""",
    "envelope_meta": f"""select 'supplier-risk' as product, '1.0' as version, 'v1' as api_version,
        timestamp '2026-12-03 10:42:00' as generated_at,
        cast(least(10, greatest(count(*) - 5, 0)) as bigint) as row_count, count(*) as total_count,
        'neo4j+postgres' as source, 'miss' as cache, false as deprecated, cast(null as date) as sunset
      from ({risk_sql()}) r""",
    "distinct_values": V_FLAT + "select distinct werk as wert from flat where werk is not null and werk <> ''",
    "content_fingerprint": fingerprint_sql(
        {"p_partkey": "cast(p_partkey as varchar)", "p_name": "p_name", "p_brand": "p_brand", "p_type": "p_type",
         "p_size": "cast(p_size as varchar)",
         "p_retailprice": "cast(cast(round(p_retailprice * 100) as bigint) as varchar)"}, "part"),
    "content_fingerprint_nulls": V_FLAT + fingerprint_sql(
        {"material_nr": "material_nr",
         "bezeichnung": "(case when bestand > 2000 then '-' else bezeichnung || ':1:-' end)",
         "warengruppe": "warengruppe", "werk": "werk", "status": "status", "einheit": "einheit",
         "bestand": "cast(bestand as varchar)", "geaendert": "geaendert"}, "flat"),
    # W
    "latest_version": """select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
      from (select *, row_number() over (partition by o_custkey
              order by (o_orderstatus = 'F') asc, o_orderdate desc, o_orderkey desc) rn from orders) t
      where rn = 1""",
    "key_collisions": """select l_orderkey, l_linenumber, count(*) as anzahl from lineitem
      group by l_orderkey, l_linenumber having count(*) > 1""",
    "upsert_by_key": with_views(MAPPING_EVENTS, LATEST_MAPPING) + "select * from latest_mapping",
    # O
    "top_risk": f"select * from ({risk_sql()}) r order by risiko_score desc, lieferant_id limit 10",
    "page": V_MAT + f"select * from (select {V2_COLS} from materials) v order by material_nr limit 10 offset 5",
    "sorted_page": V_FLAT + "select * from flat order by bestand desc nulls last, "
                   + ", ".join(f"{c} asc nulls last" for c in _FLAT_ORDER.split(", "))
                   + " limit 20 offset 40",
    # U
    "contract_violations": V_FLAT + _violations(MATERIAL_RULES, "flat"),
    "delivery_violations": V_DEL + """, faulty as (
        select case when menge % 7 <> 0 then lieferant_id end as lieferant_id, material_nr, geliefert_am,
          case when day(geliefert_am) <> 13 then zugesagt_am end as zugesagt_am,
          case when menge % 11 = 0 then 0 else menge end as menge,
          case when menge % 13 = 0 then -1 else reklamationen end as reklamationen from lieferungen)
      """ + _violations(DELIVERY_RULES, "faulty"),
    "mapping_rejects_absent": V_MAT + "select material_nr, 'ziel_warengruppe fehlt' as grund from materials",
    "sample_supplier_links": SAMPLE,
    "purge_mock_nodes": V_GRAPH_LIVE + "select * from nodes",
    "purge_mock_edges": V_GRAPH_LIVE + "select * from edges",
    "purge_label_filtered": V_GRAPH_LIVE + "select * from edges",
    "scan_materials_from_graph": V_MAT + """select material_nr, bezeichnung, nullif(warengruppe, '') as warengruppe,
      werk_id, werk_name, status, einheit, bestand, preis, geaendert from materials""",
    "snapshot_states": f"""with n as (select count(*) as zeilen from ({risk_sql()}) r)
      select cast(schritt as int) as schritt, zustand, zeilen
      from (values (1, 'miss'), (2, 'hit'), (3, 'miss'), (4, 'bypass'), (5, 'miss'), (6, 'hit')) t(schritt, zustand), n""",
    "snapshot_eviction": V_MAT + """select k as schluessel, z as zustand, (select count(*) from materials where status = s) as zeilen
      from (values ('a', 'hit', 'Gesperrt'), ('b', 'miss', '-'), ('c', 'hit', 'Aktiv')) t(k, z, s)""",
    "ordered_materials_all": V_MAT + "select row_number() over (order by material_nr) as position, * from materials",
    "ordered_suppliers_all": V_SUP + "select row_number() over (order by lieferant_id) as position, * from suppliers",
    "ordered_deliveries_all": V_DEL + DELIVERY_ORDER,
    "page_by_ranges": V_DEL + "select * from (" + DELIVERY_ORDER + ") o where position > 1000 and position <= 1500",
    "product_page_supplier_risk": f"""select * from (
      select row_number() over (order by risiko_score desc, lieferant_id) as position, * from ({risk_sql()}) r) p
      where position between 11 and 30""",
    "page_after": V_MAT + f"""select row_number() over (order by material_nr) as position, *
      from (select {V2_COLS} from materials where material_nr > 'MAT-101' order by material_nr limit 50) v""",
    "ordered_materials": V_MAT + """select * from (
      select row_number() over (order by material_nr) as position, * from materials) m where position <= 50""",
    "mapping_rejects": V_MAT + """select material_nr, case
        when material_nr is null then 'material_nr fehlt'
        when length(material_nr) < 1 then 'material_nr zu kurz'
        when length(material_nr) > 40 then 'material_nr zu lang'
        when warengruppe is null then 'ziel_warengruppe fehlt'
        when length(warengruppe) < 1 then 'ziel_warengruppe zu kurz'
        when length(warengruppe) > 80 then 'ziel_warengruppe zu lang'
        when bezeichnung is not null and length(bezeichnung) > 500 then 'kommentar zu lang'
      end as grund from materials""",
    # E
    "supplier_risk": risk_sql(),
    "supplier_risk_tolerance": risk_sql(tol=3),
    # parameter variants
    "material_overview_v1_unclassified": V_MAT + """
      select material_nr, bezeichnung, nullif(warengruppe, '') as warengruppe, werk_name as werk, status,
             einheit, bestand, geaendert
      from materials
      where nullif(warengruppe, '') is null
        and contains(lower(material_nr || ' ' || coalesce(bezeichnung, '')), 'blue')""",
    "supplier_risk_classes_min": risk_sql(tol=2, min_n=340, classes=("mittel", "niedrig")),
    "sorted_page_by_name": V_FLAT + "select * from flat order by bezeichnung asc nulls last, "
                           + ", ".join(f"{c} asc nulls last" for c in _FLAT_ORDER.split(", "))
                           + " limit 20 offset 60",
    "column_filters_ops": V_FLAT + """select * from flat
      where bestand < 2000 and lower(einheit) <> 'st' and lower(werk) >= 'nation_2'""",
    "plant_load_min": V_MAT + """select werk_id, min(werk_name) as werk_name, count(*) as materialien,
        cast(sum(coalesce(bestand, 0)) as bigint) as bestand_gesamt
      from materials group by werk_id having count(*) >= 100""",
    "page_deep": V_MAT + f"select * from (select {V2_COLS} from materials) v order by material_nr limit 50 offset 1000",
    "envelope_meta_deprecated": V_MAT + """select 'material-overview' as product, '1.2' as version,
        'v1' as api_version, timestamp '2026-12-03 10:42:00' as generated_at,
        cast(least(20, greatest(count(*) - 40, 0)) as bigint) as row_count, count(*) as total_count,
        'neo4j' as source, 'miss' as cache, true as deprecated, date '2026-12-31' as sunset
      from materials
      where status in ('Aktiv', 'Obsolet') and werk_name in ('NATION_1', 'NATION_2', 'NATION_5')
        and contains(lower(material_nr || ' ' || coalesce(bezeichnung, '')), 'o')""",
    "distinct_groups": V_FLAT + """select distinct warengruppe as wert from flat
      where warengruppe is not null and warengruppe <> ''""",
}
