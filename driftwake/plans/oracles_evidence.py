"""Oracle SQL for the scene and evidence queries."""

from __future__ import annotations

from driftwake.functions import hexgrid
from driftwake.plans import oracle_parts as p
from driftwake.plans import oracles_quality as oq
from driftwake.plans import oracles_vessel as ov

_DX = "(2000.0e0/" + p.lon_m("least(89.0e0,greatest(abs(y0),abs(y1))+2.0e0/110.0e0)") + ")"
_AT = """
sg as (select mmsi, coalesce(lag(t_us) over w,t_us) t0, t_us t1, coalesce(lag(lat) over w,lat) lat0, lat lat1, coalesce(lag(lon) over w,lon) lon0, lon lon1 from {ais} window w as (partition by mmsi order by t_us)),
fp as (select scene_id, mmsi, x0, y0, x1, y1, lat0+(lat1-lat0)*(case when t1>t0 then (acq_us-t0)/(t1-t0) else 0.0e0 end) lat, lon0+(lon1-lon0)*(case when t1>t0 then (acq_us-t0)/(t1-t0) else 0.0e0 end) lon
  from {scenes} join sg on acq_us>=t0 and acq_us<=t1 and (acq_us>t0 or t0=t1)),
fq as (select *, lon between x0 and x1 and lat between y0 and y1 inside from fp where lon between x0-""" + _DX + " and x1+" + _DX + """ and lat between y0-2.0e0/110.0e0 and y1+2.0e0/110.0e0)"""
_MATCH = _AT + """,
gp as (select t.scene_id, target_id, mmsi, """ + p.dist_m("t.lat", "t.lon", "fq.lat", "fq.lon") + """/1000.0e0 km from {scene_targets} t join fq on fq.scene_id=t.scene_id),
ga as (select *, row_number() over (partition by scene_id, target_id order by km, mmsi) rt, row_number() over (partition by scene_id, mmsi order by km, target_id) rv from gp where km<=2.0e0),
mt as (select scene_id, target_id, mmsi, km from ga where rt=1 and rv=1),
ml as (select scene_id, target_id, mmsi, km, 'MATCHED' classification from mt
  union all select scene_id, target_id, cast(null as bigint), cast(null as double), 'DARK' from {scene_targets} where (scene_id, target_id) not in (select scene_id, target_id from mt)
  union all select scene_id, cast(null as bigint), mmsi, cast(null as double), 'PHANTOM' from fq where inside and (scene_id, mmsi) not in (select scene_id, mmsi from mt)),
rv as (select mmsi, bool_or(classification='MATCHED') radar_matched, count(*) filter (where classification='MATCHED') n_matched, count(*) filter (where classification='PHANTOM') n_phantom from ml where mmsi is not null group by mmsi)"""
_TRUST = "with " + ov.TRUST_EVIDENCE.strip() + "," + _MATCH + """,
te as (select s.*, case when s.classification='IDENTITY_MISMATCH' then s.classification when r.radar_matched=false then 'PHANTOM' else 'MATCHED' end cl, """ + ov.CODES + """ codes from scored s left join rv r on r.mmsi=s.mmsi)"""
_SURFACE = "sf as (select cast(p_size as double) a, p_partkey%6+1.0e0 c, avg(case when (p_partkey*7919)%100<p_size+10*(p_partkey%6) then 1.0e0 else 0.0e0 end) r from part group by all), cells as (select * from sf)"
_OF = lambda rq: (_SURFACE + oq._ASSESS.removeprefix(oq._CELLS)).replace("least(area_km2,2.5e0)", "least(area_km2,(select max(a) from cells))").replace("{requests}", rq)
_KINDS = "rq as (select request_id*10+k request_id, a area_km2, contrast_db, cloud_fraction, daylight_fraction, persistence_hours from {requests} cross join (values (0,15.0e0),(1,7.0e0),(2,1.0e0)) v(k,a))"



def _hex(src: str, keep: str, level: int, name: str, out: str) -> str:
    """CTEs that add the hexagonal index of (lat, lon) to a source."""
    e, r3 = repr(hexgrid.edge_km(level)) + "e0", repr(hexgrid.ROOT3) + "e0"
    size = f"(1100.0e0/pow(7.0e0,{level}/2.0e0))" if level % 2 else e
    return f"""
{name}a as (select {keep}, radians(mod(lon+180.0e0,360.0e0)-180.0e0)*6371.0088e0 x, sin(radians(lat))*6371.0088e0 y from {src}),
{name}b as (select *, (x*({r3}/3.0e0)-y/3.0e0)/{size} q, y*(2.0e0/3.0e0)/{size} r from {name}a),
{name}c as (select *, floor(q+0.5e0) rq, floor(r+0.5e0) rr, floor(-q-r+0.5e0) rs from {name}b),
{name} as (select {keep}, {level}::bigint*72057594037927936+cast(case when abs(rq-q)>abs(rr-r) and abs(rq-q)>abs(rs+q+r) then -rr-rs else rq end+134217728 as bigint)*268435456
  +cast(case when abs(rr-r)>=abs(rq-q) and abs(rr-r)>abs(rs+q+r) then -rq-rs else rr end+134217728 as bigint) {out} from {name}c)"""


_UP = f"""
ct as (select cell, n, ((cell>>28)&268435455)-134217728 q, (cell&268435455)-134217728 r from (select cell, count(*) n from hx group by cell) g),
cc as (select cell, n, degrees(asin(r*1.5e0*(1100.0e0/pow(7.0e0,3.5e0))/6371.0088e0)) lat, degrees((q+r/2.0e0)*{hexgrid.ROOT3!r}e0*(1100.0e0/pow(7.0e0,3.5e0))/6371.0088e0) lon from ct)"""

# truths of a scene one by one, each with the list of detections taken so far
_GREEDY = _AT + """,
tp as (select scene_id, mmsi truth_id, (y1-lat)*500.0e0 r, (lon-x0)*500.0e0 c from fq where inside),
dt as (select scene_id, target_id det_id, (y1-lat)*500.0e0 r, (lon-x0)*500.0e0 c from {scene_targets} join {scenes} using (scene_id)),
cd as (select tp.scene_id, truth_id, dt.det_id, sqrt((tp.r-dt.r)*(tp.r-dt.r)+(tp.c-dt.c)*(tp.c-dt.c)) px from tp join dt on dt.scene_id=tp.scene_id where abs(tp.r-dt.r)<=30.0e0 and abs(tp.c-dt.c)<=30.0e0),
cl as (select scene_id, truth_id, row_number() over (partition by scene_id order by truth_id) n, list(struct_pack(px := px, det_id := det_id) order by px, det_id) opts from cd where px<=30.0e0 group by scene_id, truth_id),
gr as (select scene_id, truth_id, n, opts[1] got, [opts[1].det_id] used from cl where n=1
  union all select scene_id, truth_id, n, got, case when got is null then used else list_append(used, got.det_id) end from (
    select cl.scene_id, cl.truth_id, cl.n, used, list_filter(cl.opts, lambda o: not list_contains(gr.used, o.det_id))[1] got from gr join cl on cl.scene_id=gr.scene_id and cl.n=gr.n+1) q)"""

_SEPARATION = "lt_src as (select mmsi, t_us, sog from {ais})," + p.runs_sql("lt_src", "sog>5.0e0", "avg(sog) mean_sog", "lt") + """,
bt as (select mmsi, run_start t0, last_true t1 from (select *, row_number() over (partition by mmsi order by last_true-run_start desc, run_start) k from lt) q where k=1),
ow as (select a.mmsi, a.t_us, a.lat, a.lon, t0, t1, row_number() over (partition by a.mmsi order by a.t_us, a.event_id)-1 v, count(*) over (partition by a.mmsi) n from {ais} a join bt on bt.mmsi=a.mmsi and a.t_us between t0 and t1),
mv as (select mmsi, t_us, lat, lon from {ais} where sog>1.0e0),
en as (select bt.mmsi, count(*) filter (where mv.mmsi<>bt.mmsi) c from bt join mv on mv.t_us between t0-1800000000 and t1+1800000000 group by bt.mmsi),
ds as (select o.mmsi, v, min(""" + p.dist_m("o.lat", "o.lon", "mv.lat", "mv.lon") + """)/1000.0e0 km from ow o join mv on mv.mmsi<>o.mmsi and mv.t_us between t0-1800000000 and t1+1800000000 where v%greatest(1,n//25)=0 and n>=3 group by o.mmsi, v),
md as (select mmsi, count(*) samples, median(km) km from ds group by mmsi),
ln as (select mmsi, any_value(n) n from ow group by mmsi)"""

ORACLES: dict[str, str] = {
    "track_separation": "with " + _SEPARATION + """ select ln.mmsi, case when n>=3 and coalesce(c,0)>=5 then coalesce(samples,0) else 0 end samples, round(case when n<3 then 0.0e0 when coalesce(c,0)<5 then 999.0e0 else km end,4) separation_km
from ln left join en using (mmsi) left join md using (mmsi)""",
    "reference_match": "with recursive " + _GREEDY.strip() + " select scene_id, truth_id, got.det_id det_id, round(got.px,4) px from gr where got is not null",
    "hex_index": "with " + _hex("{ais}", "event_id", 7, "hx", "cell") + " select event_id, cell from hx",
    "hex_parents": "with " + _hex("{ais}", "event_id", 7, "hx", "cell") + "," + _UP + "," + _hex("cc", "n", 6, "hp", "parent") + " select parent, count(*) cells, cast(sum(n) as bigint) reports from hp group by parent",
    "hex_baseline": "with " + _hex("{sigma0_at}", "scene_id, wind_ms, v", 7, "hx", "cell") + f" select cell, {oq._BIN} wind_bin, count(*) n, count(distinct scene_id) scenes, round(sum(v)/count(*),6) mean, round(sqrt(greatest(sum(v*v)/count(*)-pow(sum(v)/count(*),2),1e-9)),5) std from hx group by all",
    "scene_match": "with " + _MATCH + " select scene_id, target_id, mmsi, round(km,4) km, classification from ml",
    "scene_positions": "with " + _AT + " select scene_id, mmsi, round(lat,6) lat, round(lon,6) lon from fq where inside",
    "radar_evidence": "with " + _MATCH + " select * from rv",
    "strongest_targets": "select scene_id, rn as rank, target_id, peak_intensity, pixels from (select *, row_number() over (partition by scene_id order by peak_intensity desc, pixels desc, target_id) rn from {scene_targets}) q where rn<=5",
    "trust_evidence": _TRUST + " select mmsi, n_fixes, round(score,6) score, cl classification, trust_prior, codes from te",
    "identity_mismatches": _TRUST + " select mmsi, round(score,6) score, trust_prior, codes from te where cl='IDENTITY_MISMATCH'",
    "unexpected_flags": _TRUST + """, u as (select mmsi, unnest(string_split(codes, ',')) code from te where codes<>'')
select mmsi, code from u where code<>case when mmsi%100000%11=3 then 'POSITION_TELEPORT' when mmsi%100000%5=0 then 'SOG_DISAGREEMENT' else 'AIS_GAP' end""",
    "dwell_ranking": """with b as (select * from {ais} where lon between 69.0e0 and 71.5e0 and lat between 16.0e0 and 18.5e0),
d as (select mmsi, (max(t_us)-min(t_us))/3.6e9 dwell, min(pow(lon-70.25e0,2)+pow(lat-17.25e0,2)) c2, count(*) fixes, max(sog) top from b group by mmsi)
select mmsi, round(dwell,10) dwell_h, round(c2,6) centre_d2, fixes, row_number() over (order by dwell desc, c2, mmsi) as rank from d where top>1 order by dwell desc, c2, mmsi limit 10""",
    "detectability_measured": "with " + _OF("{requests}") + oq.ORACLES["detectability"].removeprefix("with " + oq._ASSESS).replace("then r end measured_rate", "then round(r,6) end measured_rate"),
    "size_class_comparison": "with " + _KINDS + "," + _OF("rq") + oq.ORACLES["first_detection"].removeprefix("with " + oq._ASSESS).replace("{requests}", "rq").replace(
        "select r.request_id, fw.sensor", "select r.request_id//10 request_id, case r.request_id%10 when 0 then 'large' when 1 then 'medium' else 'small' end size_class, r.area_km2, fw.sensor"),
}
