"""Domain views derived from the driver's tables, one text per view for Spark and DuckDB.

Every view reads the given tables, so its size follows theirs. ``{t}`` names a raw table or an
earlier view; ``<gen a,b,c>`` multiplies rows by c = a..b; ``<us>`` is microseconds of the
event time; ``<sha x>`` is SHA-256 in hex; ``<pos v>`` unnests a vector with its position.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
              "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Audit entries without their links, and the sequence numbers that are linked in one go.
_ENTRIES = "select o_orderkey seq, o_custkey incident_id, concat('body-', cast(o_orderkey as <str>), '-', o_orderstatus) body from {orders}"
_LINK_RANGE = 100_000

VIEWS: dict[str, str] = {
    # vessel reports: events compressed 60x in time along straight tracks, with planted anomalies
    "ais": """
with c as (select event_id, user_id i, (select min(<us>) from {events}) us0,
             cast(floor((<us> - (select min(<us>) from {events}))/60.0e0) as bigint) rel_us from {events}),
k as (select *, cast(rel_us as double)/1000000.0e0 s,
        15.5e0+(i*7919%4000)/1000.0e0 lat0, 68.5e0+(i*104729%4000)/1000.0e0 lon0,
        cast((i*137)%360 as double) course, cast(case when i%13=12 then 0 else 6+i%9 end as double) v from c),
p as (select *,
        case when i%5=0 then s-greatest(0.0e0, least(s,25200.0e0)-14400.0e0)
             when i%5=1 then s-0.7e0*greatest(0.0e0, least(s,21600.0e0)-14400.0e0) else s end se,
        case when i%13=12 then 0.1e0
             when i%5=0 and s>=14400.0e0 and s<25200.0e0 then 0.4e0
             when i%5=1 and s>=14400.0e0 and s<21600.0e0 then 0.3e0*v else v end sog0,
        case when i%11=3 and event_id%17=0 then 1.0e0 else 0.0e0 end jump from k)
select event_id,
  cast((case i%6 when 0 then 419 when 1 then 371 when 2 then 636 when 3 then 538 when 4 then 563 else 352 end)*1000000+100000+i as bigint) mmsi,
  us0+rel_us t_us,
  floor((lat0+v*0.514444e0*se*cos(radians(course))/110574.0e0+0.38e0*jump)*1000000.0e0+0.5e0)/1000000.0e0 lat,
  floor((lon0+v*0.514444e0*se*sin(radians(course))/(111320.0e0*cos(radians(lat0)))+0.31e0*jump)*1000000.0e0+0.5e0)/1000000.0e0 lon,
  round(cast(sog0 as double),3) sog,
  case when event_id%6=0 then null
       when i%5=2 and s>=18000.0e0 and s<25200.0e0 then cast((cast(course as bigint)+90)%360 as double) else course end cog,
  case when event_id%2=0 then null else course end heading,
  cast(case i%8 when 0 then 80 when 1 then 70 when 2 then 30 when 3 then 52 when 4 then 31 when 5 then 60 when 6 then null else 84 end as bigint) type_code,
  case when i%3=0 then null else concat('IMO', cast(9000000+i as <str>)) end imo_text,
  case when i%10=7 then 'US' when i%6=0 then 'IN' when i%6=2 then 'LR' when i%6=3 then 'MH' when i%6=4 then 'SG' else 'PA' end flag,
  case when i%7=0 then null else cast(60+(i%10)*25 as double) end length_m
from p""",
    "ais_raw": """
select * from {ais} union all
select event_id+100000000, mmsi, t_us, lat+case when event_id%100=0 then 0.05e0 else 0.0e0 end, lon, sog, cog, heading,
  type_code, imo_text, flag, length_m from {ais} where event_id%50=0""",
    # one incident per supplier, downdrift of where one vessel starts: acquisition instant, slick centre, area
    "incidents": """
select s_suppkey incident_id, (select min(<us>) from {events})+43200000000-(s_suppkey%5)*420000000 acq_us,
  round(68.83e0+(s_suppkey*104729%4000)/1000.0e0,4) cx, round(15.72e0+(s_suppkey*7919%4000)/1000.0e0,4) cy,
  round(5.0e0+s_acctbal/60.0e0,3) area_km2, cast(s_nationkey as bigint) nation_key from {supplier}""",
    # hour-by-hour origin polygon behind each incident, drifting and widening with time
    "steps": """
select incident_id, cast(h as bigint) hours_back, acq_us-h*3600000000 t_us,
  round(cx-0.03e0*h,6) cx, round(cy-0.02e0*h,6) cy, round(0.12e0+0.012e0*h,6) r from (select *, h from {incidents} <gen 1,16,h>) g""",
    "step_edges": """
select incident_id, hours_back, t_us, cast(k as bigint) k,
  round(cx+r*cos(radians(15.0e0*k)),6) x1, round(cy+r*sin(radians(15.0e0*k)),6) y1,
  round(cx+r*cos(radians(15.0e0*((k+1)%24))),6) x2, round(cy+r*sin(radians(15.0e0*((k+1)%24))),6) y2
from (select *, k from {steps} <gen 0,23,k>) g""",
    # three elongated detections per incident
    "slick_points": """
select incident_id*3+d slick_id, incident_id, cast(k as bigint) k,
  round(cx+0.4e0*d+(0.10e0+0.002e0*(incident_id%20))*cos(radians(10.0e0*k))*cos(radians(17.37e0+25.0e0*d+incident_id%40))-0.03e0*sin(radians(10.0e0*k))*sin(radians(17.37e0+25.0e0*d+incident_id%40)),6) x,
  round(cy-0.3e0*d+(0.10e0+0.002e0*(incident_id%20))*cos(radians(10.0e0*k))*sin(radians(17.37e0+25.0e0*d+incident_id%40))+0.03e0*sin(radians(10.0e0*k))*cos(radians(17.37e0+25.0e0*d+incident_id%40)),6) y
from (select *, cast(d0 as bigint) d from (select *, d0 from {incidents} <gen 0,2,d0>) a) b <gen 0,35,k>""",
    # the outline that was planted near one of an incident's detections
    "planted_points": """
select incident_id, cast(k as bigint) k,
  round(cx+0.4e0*(incident_id%3)+0.015e0+0.115e0*cos(radians(10.0e0*k))*cos(radians(27.0e0+25.0e0*(incident_id%3)+incident_id%40))-0.034e0*sin(radians(10.0e0*k))*sin(radians(27.0e0+25.0e0*(incident_id%3)+incident_id%40)),6) x,
  round(cy-0.3e0*(incident_id%3)+0.115e0*cos(radians(10.0e0*k))*sin(radians(27.0e0+25.0e0*(incident_id%3)+incident_id%40))+0.034e0*sin(radians(10.0e0*k))*cos(radians(27.0e0+25.0e0*(incident_id%3)+incident_id%40)),6) y
from (select *, k from {incidents} <gen 0,35,k>) g""",
    # one gridded wind/current field per incident; some retrievals are missing
    "env": """
select incident_id field_id, cast(ti as bigint) ti, cast(yi as bigint) yi, cast(xi as bigint) xi,
  acq_us-43200000000+ti*3600000000 t_us, round(cy-2.0e0+0.5e0*yi,4) lat, round(cx-2.0e0+0.5e0*xi,4) lon,
  case when (ti+3*yi+5*xi+incident_id)%23=0 then null else round(4.0e0+(incident_id%9)+3.0e0*sin(0.3e0*ti+0.5e0*xi),4) end wind_u,
  case when (ti+3*yi+5*xi+incident_id)%23=0 then null else round(2.0e0*cos(0.2e0*ti+0.4e0*yi),4) end wind_v,
  round(0.2e0+0.1e0*sin(0.5e0*xi),4) curr_u, round(0.1e0*cos(0.5e0*yi),4) curr_v
from (select *, xi from (select *, yi from (select *, ti from {incidents} <gen 0,14,ti>) a <gen 0,8,yi>) b <gen 0,8,xi>) c""",
    # scored releases: one row per (incident, vessel, k) seen in the order lines
    "hyps": """
select distinct incident_id, cast((case i%6 when 0 then 419 when 1 then 371 when 2 then 636 when 3 then 538 when 4 then 563 else 352 end)*1000000+100000+i as bigint) mmsi, k,
  acq0-(k+1)*5400000000-(incident_id%5)*420000000 release_us,
  round(((i*31+k*17+incident_id*3)%100)/125.0e0,4) iou, round(((i*7+k*13+incident_id*11)%300)/10.0e0,4) offset_km,
  round(cast((i*11+k*29+incident_id*5)%91 as double),4) delta_deg, round((1+(i*3+k*5+incident_id*7)%99)/100.0e0,4) area_ratio
from (select l_suppkey incident_id, l_orderkey%(select max(user_id)+1 from {events}) i, cast(l_linenumber as bigint) k,
        (select min(<us>) from {events})+43200000000 acq0 from {lineitem}) q""",
    # scan lines of 64 pixels from embedding vectors; 64 lines make a scene
    "pixels": """
select scene_id, row_id, col_id, cast(case when col_id<2 then 0
    when row_id%16 between 7 and 9 and col_id%32 between 15 and 17 and row_id<32 then 245
    when row_id between 40 and 52 and col_id between 10 and 45 then 25.0e0+floor(least(20.0e0,abs(noise)*20.0e0))
    else greatest(90.0e0,least(160.0e0,floor(125.0e0+noise*60.0e0))) end as bigint) dn
from (select cast(floor(vec_id/64) as bigint) scene_id, vec_id%64 row_id, cast(pos as bigint) col_id, cast(v as double) noise from (<pos embedding {embeddings}>) u) p""",
    "sigma0": """
select l_suppkey scene_id, l_partkey%400 cell, round(l_quantity/4.0e0,2) wind_ms, round(-25.0e0+60.0e0*l_discount+20.0e0*l_tax,3) v,
  l_orderkey, cast(l_linenumber as bigint) line from {lineitem}""",
    # the same samples with the positions they were taken at
    "sigma0_at": """
select scene_id, wind_ms, v, round(14.0e0+0.013e0*(cell%20)+0.0007e0*(l_orderkey%17),6) lat, round(69.0e0+0.017e0*floor(cell/20.0e0)+0.0009e0*(l_orderkey%13),6) lon, l_orderkey, line from {sigma0}""",
    "chips": """
select l.doc_id chip_id, d.lang sensor, cast(l.quality as bigint) target, round(((l.doc_id*37+l.quality*45)%100)/100.0e0,2) prob_a,
  round(((l.doc_id*53+l.quality*55)%100)/100.0e0,2) prob_b, case when d.n_chars%11=0 then 0.0e0 else round((d.n_chars%997)/1000.0e0,4) end oil_fraction
from {labels} l join {documents} d on l.doc_id=d.doc_id""",
    "stations": """
select cast(n_nationkey as bigint) station_id, case when n_nationkey=0 then 'NATIONAL_HQ' when n_nationkey<=4 then 'REGION_HQ' when n_nationkey<=10 then 'DISTRICT_HQ' else 'STATION' end role,
  r_name region, round(8.0e0+(n_nationkey*37%150)/10.0e0,3) lat, round(68.0e0+(n_nationkey*53%220)/10.0e0,3) lon,
  cast(case when n_nationkey=0 then 3 when n_nationkey<=4 then 2 else 1 end as bigint) tier_min
from {nation} join {region} on n_regionkey=r_regionkey""",
    # one meandering north-south shore, finer as the parts table grows
    "coast": """
select p_partkey seg_id, round(72.6e0+0.3e0*sin(28.0e0*p_partkey/n),6) x1, round(14.0e0+8.0e0*p_partkey/n,6) y1,
  round(72.6e0+0.3e0*sin(28.0e0*(p_partkey+1)/n),6) x2, round(14.0e0+8.0e0*(p_partkey+1)/n,6) y2
from (select p_partkey, (select cast(count(*) as double) from {part}) n from {part}) q""",
    # distance-to-coast series per order: up to seven six-hour horizons
    "horizons": """
select l_orderkey incident_id, cast(l_linenumber*6 as bigint) horizon_hours,
  round(greatest(0.0e0, 8.0e0+(l_orderkey%30)+min(l_quantity)/10.0e0-6.0e0*l_linenumber*(0.2e0+0.3e0*(l_orderkey%4))),3) distance_km,
  floor(max(l_extendedprice)/4.0e0)/100.0e0+0.003e0 area_km2 from {lineitem} group by l_orderkey, l_linenumber""",
    "targets": """
select 900000+mmsi%100000 target_id, round(lat+case when mmsi%2=0 then 0.004e0 else 0.03e0 end,6) lat, round(lon-0.003e0,6) lon, t_us from (select *, row_number() over (partition by mmsi order by abs(t_us-(select min(<us>)+21600000000 from {events})), event_id) rn from {ais}) q where rn=1 and mmsi%3=0""",
    # one radar scene per incident, its footprint about the slick; and the targets it shows: vessels near their fixes, some off them, some unseen
    "scenes": """
select incident_id scene_id, acq_us, round(cx-1.2e0,4) x0, round(cy-1.2e0,4) y0, round(cx+1.2e0,4) x1, round(cy+1.2e0,4) y1 from {incidents}""",
    "scene_targets": """
select scene_id, scene_id*1000000+mmsi%100000 target_id, round(lat+case when mmsi%2=0 then 0.004e0 else 0.03e0 end,6) lat, round(lon-0.003e0,6) lon,
  round(30.0e0+(mmsi*31+scene_id*7)%97/4.0e0,3) peak_intensity, cast(4+(mmsi+scene_id)%40 as bigint) pixels
from (select s.scene_id, a.mmsi, a.lat, a.lon, row_number() over (partition by s.scene_id, a.mmsi order by abs(a.t_us-s.acq_us), a.event_id) rn
  from {ais} a join {scenes} s on cast(floor(a.t_us/600000000.0e0) as bigint)=cast(floor(s.acq_us/600000000.0e0) as bigint) and a.lon between s.x0 and s.x1 and a.lat between s.y0 and s.y1) q where rn=1 and mmsi%3<>1""",
    "observations": """
select concat('obs-', cast(page_id as <str>)) observation_id, case page_id%3 when 0 then 'REAL_REPLAY' when 1 then 'SYNTHETIC' else 'LIVE_NRT' end mode, url product, case when page_id%4=0 then null else page_id*3600000000 end acquired_us, page_id%3<>2 pixels_local from {pages}""",
    "audit": f"""
select seq, incident_id, case when seq%333=5 then concat(body,'!') else body end body, <sha body> chain_hash, case when seq%400=0 then 'broken' else lag(<sha body>,1,'0') over (order by seq) end prev_hash
from ({_ENTRIES}) q""",
    # detection questions asked of the sensors: one slick area and contrast per part
    "requests": """
select p_partkey request_id, round(0.002e0+(p_partkey*37%997)/60.0e0*(p_size/25.0e0),4) area_km2, round(0.5e0+(p_partkey%140)/10.0e0,2) contrast_db,
  (p_partkey%11)/10.0e0 cloud_fraction, 0.25e0+(p_partkey%3)*0.25e0 daylight_fraction, cast(12+(p_partkey%4)*12 as double) persistence_hours from {part}""",
    "offences": "select distinct mmsi, cast(1+mmsi%3 as bigint) n_offences from {ais} where mmsi%7=0",
    "calibration": """
select p_partkey scene_id, -10.0e0+(p_partkey%37)/7.0e0 k_sigma, 20.0e0+(p_partkey%25) incidence_deg,
  round(-10.0e0+(p_partkey%37)/7.0e0+10.0e0*log10(sin(radians(20.0e0+(p_partkey%25))))+case when p_partkey%9=0 then 0.2e0 else 0.0e0 end,4) k_beta,
  round(-10.0e0+(p_partkey%37)/7.0e0+10.0e0*log10(cos(radians(20.0e0+(p_partkey%25)))),4) k_gamma, 1.0e0+p_size noise_bias,
  round(-20.0e0+(p_partkey%50),2) lat, round(60.0e0+(p_partkey%40),2) lon, (select min(<us>) from {events})+p_partkey*1800000000 acq_us,
  round(-30.0e0+(p_partkey*7%110),2) sun_elevation from {part}""",
}


def _refs(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)))


def _dialect(text: str, spark: bool) -> str:
    us = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts)" if spark else "epoch_us(ts)"
    text = text.replace("<us>", us).replace("<str>", "string" if spark else "varchar")
    text = re.sub(r"<sha (\w+)>", r"sha2(\1,256)" if spark else r"sha256(\1)", text)
    gen = r"lateral view explode(sequence(\1,\2)) as \3" if spark else r"cross join unnest(range(\1,\2+1)) as _g_\3(\3)"
    text = re.sub(r"<gen (\d+),(\d+),(\w+)>", gen, text)
    pos = (r"select * from {\2} lateral view posexplode(\1) as pos, v" if spark
           else r"select *, unnest(\1) v, generate_subscripts(\1,1)-1 pos from {\2}")
    return re.sub(r"<pos (\w+) \{(\w+)\}>", pos, text)


def _audit(entries: DataFrame, width: int = _LINK_RANGE) -> DataFrame:
    """The ``audit`` view with its links found range by range: one window over all entries is one task. No sequence number comes first, as there.

    Ranges send one row each to the others, which are broadcast, so rows leave in the order they were linked in and repeated numbers keep theirs.
    """
    seq, here = F.col("seq"), F.struct("chain_hash")
    d = entries.withColumns({"chain_hash": F.sha2("body", 256), "_range": F.coalesce(F.floor(seq / width), F.lit(-(1 << 62)))})
    last = d.groupBy("_range").agg(F.max_by(here, F.struct("seq")).alias("_last"))
    before = last.select("_range", F.lag("_last").over(Window.orderBy("_range")).alias("_before"))
    d = d.withColumn("_prev", F.lag(here).over(Window.partitionBy("_range").orderBy("seq"))).join(F.broadcast(before), "_range")
    prev = F.coalesce("_prev", "_before")
    link = F.when(prev.isNull(), "0").otherwise(prev.chain_hash)
    return d.select("seq", "incident_id", F.when(seq % 333 == 5, F.concat("body", F.lit("!"))).otherwise(F.col("body")).alias("body"), "chain_hash",
                    F.when(seq % 400 == 0, "broken").otherwise(link).alias("prev_hash"))


def _scene_targets(ais: DataFrame, scenes: DataFrame, cell: float = 0.25) -> DataFrame:
    """The ``scene_targets`` view, its scenes and fixes joined by instant and grid cell: by time alone all reports of ten minutes meet in one task.

    A vessel's fixes about an instant are one list in the order asked for, as long as its reports of ten minutes; each scene takes the first
    in its box. Only scenes whose number comes again must choose among their answers.
    """
    slot = "cast(floor({}/600000000.0e0) as bigint)"
    near = F.sort_array(F.collect_list(F.struct(F.abs(F.col("t_us") - F.col("acq_us")).alias("d"), "event_id", "lat", "lon")))

    def found(s: DataFrame) -> DataFrame:
        at = s.select("acq_us", F.expr(slot.format("acq_us")).alias("slot")).distinct()
        fixes = ais.filter("mmsi%3<>1 and lat is not null and lon is not null").select("event_id", "mmsi", "t_us", "lat", "lon", F.expr(slot.format("t_us")).alias("slot"))
        heard = fixes.join(at, "slot").groupBy("acq_us", "mmsi").agg(near.alias("fixes"))
        place = lambda f: F.struct(F.floor(f.lon / cell).alias("cx"), F.floor(f.lat / cell).alias("cy"))
        heard = heard.withColumn("c", F.explode(F.array_distinct(F.transform("fixes", place)))).select("*", "c.cx", "c.cy").drop("c")
        span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
        listed = s.withColumn("cx", span("x0", "x1")).withColumn("cy", span("y0", "y1")).hint("merge")
        first = F.get(F.filter("fixes", lambda f: f.lon.between(F.col("x0"), F.col("x1")) & f.lat.between(F.col("y0"), F.col("y1"))), F.lit(0))
        j = listed.join(heard.hint("merge"), ["acq_us", "cx", "cy"]).select("scene_id", "cx", "cy", "mmsi", first.alias("f"))
        return j.filter((F.floor(F.col("f.lon") / cell) == F.col("cx")) & (F.floor(F.col("f.lat") / cell) == F.col("cy"))).select("scene_id", "mmsi", "f.*")

    marked = scenes.filter("x0<=x1 and y0<=y1").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("scene_id")))
    got, again = found(marked.filter("_n = 1").drop("_n")), marked.filter("_n > 1").drop("_n").distinct()
    if not again.isEmpty():
        order = Window.partitionBy("scene_id", "mmsi").orderBy("d", "event_id", "lat", "lon")
        got = got.unionByName(found(again).withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k"))
    return got.selectExpr("scene_id", "scene_id*1000000+mmsi%100000 target_id", "round(lat+case when mmsi%2=0 then 0.004e0 else 0.03e0 end,6) lat", "round(lon-0.003e0,6) lon",
                          "round(30.0e0+(mmsi*31+scene_id*7)%97/4.0e0,3) peak_intensity", "cast(4+(mmsi+scene_id)%40 as bigint) pixels")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A raw table or a derived view of it."""
    if name in RAW_TABLES:
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if name == "audit":
        return _audit(spark.sql(_dialect(_ENTRIES, spark=True), orders=table(spark, sf_dir, "orders")))
    if name == "scene_targets":
        return _scene_targets(table(spark, sf_dir, "ais"), table(spark, sf_dir, "scenes"))
    text = _dialect(VIEWS[name], spark=True)
    view = spark.sql(text, **{r: table(spark, sf_dir, r) for r in _refs(text)})
    if name == "incidents":  # dealt out by incident before they are multiplied, so that what is multiplied need not be dealt again
        view = view.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "incident_id")
    # Spark sizes a multiplied view as if it had the rows of its source, and would broadcast it
    return view.hint("merge") if "<gen " in VIEWS[name] else view


def with_views(sql: str) -> str:
    """Prefix an oracle query with the views it names in braces, as chained CTEs."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in order:
            for r in _refs(VIEWS[name]):
                visit(r)
            order.append(name)

    for r in _refs(sql):
        visit(r)
    ctes = [f"{n} as ({_dialect(VIEWS[n], spark=False).strip()})" for n in order]
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        head, body = "with recursive ", ", " + body[15:] if ctes else body[15:]
    elif body.lower().startswith("with "):
        head, body = "with ", ", " + body[5:] if ctes else body[5:]
    else:
        head, body = ("with " if ctes else ""), " " + body
    return re.sub(r"\{(\w+)\}", r"\1", head + ", ".join(ctes) + body)
