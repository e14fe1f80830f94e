"""Oracle SQL for the track, trust and behaviour queries."""

from __future__ import annotations

from driftwake.functions import vessel as _v
from driftwake.plans import oracle_parts as p

_TYPE = ("coalesce((select label from " + p.values(_v.TYPE_EXACT, "code", "label") + " where code=type_code), case "
         + " ".join(f"when type_code between {a} and {b} then '{t}'" for a, b, t in _v.TYPE_RANGES) + " end)")
_MID_REG = p.values(_v.MID_REGISTER, "mid", "iso")
_MID_ING = p.values(_v.MID_INGEST, "mid", "iso")
_MIDCHK = p.FIRST + f""",
mid as (select f.mmsi, f.flag, r.iso expected, case when r.iso is not null and r.iso<>f.flag then 'MID_FLAG_MISMATCH' when r.iso is null and length(cast(f.mmsi as varchar))>=9 then 'UNKNOWN_MID' end code
  from first_fix f left join (select * from {_MID_REG}) r on r.mid=cast(substr(cast(f.mmsi as varchar),1,3) as int) and length(cast(f.mmsi as varchar))>=9 where f.flag is not null)"""
TRUST_TAIL = """
agg as (select mmsi, count(*) n_fixes, count(*) filter (where is_dis) nd, count(*) filter (where is_tel) nt, count(*) filter (where is_acc) na, count(*) filter (where is_gap) ng from chk group by mmsi),
tr as (select a.*, m.code, case when n_fixes<3 then 1 else 0 end sparse, case when n_fixes>=3 and nd>=2 then 1 else 0 end f1, case when n_fixes>=3 and nt>0 then 1 else 0 end f2,
  case when n_fixes>=3 and na>0 then 1 else 0 end f3, case when n_fixes>=3 and m.code='MID_FLAG_MISMATCH' then 1 else 0 end f4, case when n_fixes>=3 and m.code='UNKNOWN_MID' then 1 else 0 end f5,
  case when n_fixes>=3 then least(ng,3) else 0 end f6 from agg a left join mid m on m.mmsi=a.mmsi),
scored as (select mmsi, n_fixes, sparse, f1, f2, f3, f4, f5, f6, greatest(0.0e0,least(1.0e0,1.0e0-((sparse+f5)*0.03e0+(f1+f6)*0.12e0+(f2+f3+f4)*0.35e0))) score,
  case when f4+f2>0 then 'IDENTITY_MISMATCH' else 'MATCHED' end classification,
  case when f4+f2>0 then 1.3e0 when f2+f3+f4>0 then 0.6e0 when f1+f6>0 then 0.9e0 else 1.0e0 end trust_prior from tr)"""
DUPLICATES = """
dp as (select *, lag(t_us) over w pt, lag(lat) over w plat, lag(lon) over w plon from {ais_raw} window w as (partition by mmsi order by t_us, event_id)),
dupv as (select mmsi, apart from (select mmsi, """ + p.dist_m("plat", "plon", "lat", "lon") + """/1000.0e0 apart, row_number() over (partition by mmsi order by t_us, event_id) k from dp where t_us<=pt) q where k=1 and apart>1.0e0)"""
# with duplicated identities (f7)
TRUST_DUP = DUPLICATES + "," + TRUST_TAIL.replace(
    "else 0 end f6 from agg a left join mid m on m.mmsi=a.mmsi)", "else 0 end f6, case when dv.mmsi is not null then 1 else 0 end f7 from agg a left join mid m on m.mmsi=a.mmsi left join dupv dv on dv.mmsi=a.mmsi)").replace(
    "f5, f6, greatest", "f5, f6, f7, greatest").replace("(f2+f3+f4)*0.35e0", "(f2+f3+f4+f7)*0.35e0").replace("f4+f2>0 then", "f4+f2+f7>0 then").replace("when f2+f3+f4>0", "when f2+f3+f4+f7>0")
CODES = """concat_ws(',', case when sparse=1 then 'SPARSE_TRACK' end, case when f1=1 then 'SOG_DISAGREEMENT' end, case when f2=1 then 'POSITION_TELEPORT' end, case when f3=1 then 'IMPOSSIBLE_ACCELERATION' end,
   case when f4=1 then 'MID_FLAG_MISMATCH' end, case when f5=1 then 'UNKNOWN_MID' end, case when f6>0 then 'AIS_GAP' end, case when f7=1 then 'DUPLICATE_MMSI' end)"""
TRUST_EVIDENCE = p.CHECKS + "," + _MIDCHK + "," + TRUST_DUP
_TRUST = "with " + p.CHECKS + "," + _MIDCHK + "," + TRUST_TAIL
_NIGHT = """
nd as (select mmsi, t_us, row_number() over (partition by mmsi order by t_us, event_id)-1 v, count(*) over (partition by mmsi) n from {ais}),
night as (select mmsi, avg(case when (t_us//3600000000)%24>=20 or (t_us//3600000000)%24<=3 then 1.0e0 else 0.0e0 end) ns from nd where v%greatest(1,n//200)=0 group by mmsi)"""
BEHAVIOUR_TAIL = """
gapv as (select mmsi from chk group by mmsi having count(*)>=3 and count(*) filter (where is_gap)>0),
amp as (select mmsi from loit union select mmsi from course),
fl as (select mmsi, 'SPEED_REDUCTION' code, 1.2e0 f from slow union all select mmsi, 'LOITERING', 1.25e0 from loit union all select mmsi, 'COURSE_DEVIATION', 1.15e0 from course
  union all select night.mmsi, 'NIGHT_MANOEUVRING', 1.1e0 from night where ns>0.25e0 and mmsi in (select mmsi from amp) union all select mmsi, 'AIS_GAP', 1.35e0 from gapv),
bp as (select v.mmsi, coalesce(product(f),1.0e0) bprior, coalesce(string_agg(code, ',' order by code),'') codes from (select distinct mmsi from {ais}) v left join fl on fl.mmsi=v.mmsi group by v.mmsi)"""
BEHAVIOUR_HEAD = p.NORMS.strip() + "," + p.SLOW + "," + p.COURSE + "," + p.LOITER + "," + _NIGHT + "," + p.CHECKS
_BEHAVIOUR = "with recursive " + BEHAVIOUR_HEAD + "," + BEHAVIOUR_TAIL
ALL_PRIORS = BEHAVIOUR_HEAD + "," + _MIDCHK + "," + TRUST_DUP + "," + BEHAVIOUR_TAIL
TYPE_SQL = _TYPE

ORACLES: dict[str, str] = {
    "ais_gaps": """
with d as (select * from (select *, row_number() over (partition by mmsi,t_us order by event_id) rn from {ais_raw}) q where rn=1),
g as (select mmsi, lag(t_us) over w start_us, t_us end_us, lag(lat) over w start_lat, lag(lon) over w start_lon, lat end_lat, lon end_lon from d window w as (partition by mmsi order by t_us))
select mmsi, start_us, end_us, round((end_us-start_us)/6.0e7,9) duration_min, start_lat, start_lon, end_lat, end_lon from g where (end_us-start_us)/6.0e7>15.0e0""",
    "dedup_broadcasts": "select * exclude (rn) from (select *, row_number() over (partition by mmsi,t_us order by event_id) rn from {ais_raw}) q where rn=1",
    "feed_summary": """
with v as (select mmsi, count(*) n, count(*) filter (where sog>1) mv from {ais} group by mmsi),
g as (select mmsi from (select mmsi, t_us-lag(t_us) over (partition by mmsi order by t_us) d from {ais}) q where d>900000000),
b as (select count(*) "rows", min(t_us) t_min_us, max(t_us) t_max_us, min(lon) min_lon, min(lat) min_lat, max(lon) max_lon, max(lat) max_lat,
  round(100.0e0*count(*) filter (where sog>1)/count(*),6) pct_rows_underway, round(100.0e0*count(*) filter (where heading is null)/count(*),6) null_heading_pct,
  round(100.0e0*count(*) filter (where imo_text is null)/count(*),6) null_imo_pct, round(100.0e0*count(*) filter (where type_code is null)/count(*),6) null_type_pct from {ais})
select b.*, (select count(*) from v) vessels, (select cast(median(n) as double) from v) median_reports_per_vessel, (select count(*) from v where n>=200) vessels_over_200_reports,
  (select count(*) from v where mv>0) vessels_underway, (select count(*) from g) gaps, (select count(distinct mmsi) from g) vessels_with_gaps from b""",
    "top_types": "with " + p.FIRST + f", t as (select {_TYPE} v from first_fix) select v as value, count(*) vessels from t where v is not null group by v order by vessels desc, value limit 8",
    "top_flags": "with " + p.FIRST + f", t as (select iso v from first_fix join (select * from {_MID_ING}) m on m.mid=cast(substr(cast(mmsi as varchar),1,3) as int)) select v as value, count(*) vessels from t group by v order by vessels desc, value limit 5",
    "type_decode": f"select event_id, mmsi, type_code, {_TYPE} vessel_type from {{ais}}",
    "flag_decode": f"select event_id, a.mmsi, m.iso flag_iso, try_cast(regexp_replace(upper(trim(imo_text)),'^IMO','') as bigint) imo from {{ais}} a left join (select * from {_MID_ING}) m on m.mid=cast(substr(cast(mmsi as varchar),1,3) as int) and length(cast(mmsi as varchar))>=9",
    "bbox_scan": "select event_id, mmsi, t_us, lat, lon from {ais} where lon between 69.0e0 and 71.5e0 and lat between 16.0e0 and 18.5e0",
    "segment_kinematics": "with " + p.SEG0 + " select mmsi, pt start_us, t_us end_us, round(dt_s,6) dt_s, round(dist_m,4) dist_m, round(kn,4) derived_kn from seg where pt is not null",
    "teleports": "with " + p.CHECKS + " select mmsi, n segments, t_us, round(dist_m/1000.0e0,4) jump_km, round(dt_s,6) dt_s, round(kn,4) derived_kn from (select *, count(*) over (partition by mmsi) n, row_number() over (partition by mmsi order by kn desc, t_us) k from chk where is_tel) q where k=1",
    "sog_disagreement": "with " + p.CHECKS + " select mmsi, n segments, t_us, round(rep,4) reported_kn, round(kn,4) derived_kn from (select *, count(*) over (partition by mmsi) n, row_number() over (partition by mmsi order by off desc, t_us) k from chk where is_dis) q where k=1 and n>=2",
    "impossible_acceleration": "with " + p.CHECKS + " select mmsi, n segments, t_us, round(acc,4) accel_ms2 from (select *, count(*) over (partition by mmsi) n, row_number() over (partition by mmsi order by acc desc, t_us) k from chk where is_acc) q where k=1",
    "gap_flags": "with " + p.CHECKS + " select mmsi, rn, pt at_us, round(dt_s/60.0e0,9) as minutes, plat lat, plon lon from (select *, row_number() over (partition by mmsi order by pt) rn from chk where is_gap) q where rn<=3",
    "duplicate_positions": """
with d as (select *, lag(t_us) over w pt, lag(lat) over w plat, lag(lon) over w plon from {ais_raw} window w as (partition by mmsi order by t_us, event_id)),
f as (select mmsi, t_us, """ + p.dist_m("plat", "plon", "lat", "lon") + """/1000.0e0 apart, row_number() over (partition by mmsi order by t_us, event_id) k from d where t_us<=pt)
select mmsi, t_us, round(apart,4) apart_km from f where k=1 and apart>1.0e0""",
    "mid_flag_check": "with " + _MIDCHK + " select mmsi, flag, expected, code from mid where code is not null",
    "trust_scores": _TRUST + """ select mmsi, n_fixes, round(score,6) score, classification, trust_prior,
  concat_ws(',', case when sparse=1 then 'SPARSE_TRACK' end, case when f1=1 then 'SOG_DISAGREEMENT' end, case when f2=1 then 'POSITION_TELEPORT' end, case when f3=1 then 'IMPOSSIBLE_ACCELERATION' end,
   case when f4=1 then 'MID_FLAG_MISMATCH' end, case when f5=1 then 'UNKNOWN_MID' end, case when f6>0 then 'AIS_GAP' end) codes from scored""",
    "trust_summary": _TRUST + " select count(*) scored, count(*) filter (where sparse+f1+f2+f3+f4+f5+f6>0) flagged, count(*) filter (where classification='IDENTITY_MISMATCH') identity_mismatches from scored",
    "speed_reduction_runs": "with " + p.NORMS + "," + p.SLOW + " select mmsi, run_start start_us, run_end end_us, round(hours,10) as hours, round(mean_sog,4) mean_sog, round(med,4) median_sog from slow",
    "course_deviation_runs": "with " + p.NORMS + "," + p.COURSE + " select mmsi, run_start start_us, run_end end_us, round(hours,10) as hours, round(mean_dev,4) mean_deviation from course",
    "longest_transit": "with lt_src as (select mmsi, t_us, sog from {ais})," + p.runs_sql("lt_src", "sog>5.0e0", "avg(sog) mean_sog", "lt")
        + " select mmsi, run_start start_us, last_true end_us, round((last_true-run_start)/3.6e9,10) as hours, round(mean_sog,4) mean_sog, n_rows n_fixes from (select *, row_number() over (partition by mmsi order by last_true-run_start desc, run_start) k from lt) q where k=1",
    "loiter": "with recursive " + p.NORMS.strip() + "," + p.LOITER + " select mmsi, t_us start_us, nt end_us, round((nt-t_us)/3.6e9,10) as hours, round(mean_sog,4) mean_sog, round(net_km,4) net_km, lat, lon from loit",
    "night_share": "with " + _NIGHT + " select mmsi, round(ns,6) night_share from night",
    "behaviour_priors": _BEHAVIOUR + " select mmsi, round(bprior,6) behaviour_prior, codes from bp",
    "low_speed_coverage": "select mmsi, t_us, round(avg(sog) over (partition by mmsi order by t_us range between current row and 3600000000 following),4) mean_sog from {ais}",
    "underway_predicate": "select mmsi, count(*) n_fixes, round(avg(case when sog>3 then 1.0e0 else 0.0e0 end),6) underway_fraction, count(*)>=12 and avg(case when sog>3 then 1.0e0 else 0.0e0 end)>=0.05e0 as is_eligible from {ais} group by mmsi",
    "track_decimate": "select mmsi, v as vertex, t_us, lat, lon from (select *, row_number() over (partition by mmsi order by t_us, event_id)-1 v, count(*) over (partition by mmsi) n from {ais}) q where v%greatest(1,n//20)=0",
    "nearest_fix": "select mmsi, event_id, t_us, lat, lon from (select *, row_number() over (partition by mmsi order by abs(t_us-(select min(t_us)+21600000000 from {ais})), event_id) k from {ais} where abs(t_us-(select min(t_us)+21600000000 from {ais}))<=1800000000) q where k=1",
    "aoi_dwell": "select mmsi, round((max(t_us)-min(t_us))/3.6e9,10) dwell_h, round(min(pow(lon-70.25e0,2)+pow(lat-17.25e0,2)),6) centre_d2, count(*) fixes from {ais} where lon between 69.0e0 and 71.5e0 and lat between 16.0e0 and 18.5e0 group by mmsi",
    "exposure_ranking": "with " + p.FIRST + f""",
m as (select mmsi, {_TYPE} vt, length_m from first_fix), n as (select mmsi, count(*) c from {{ais}} group by mmsi),
lt_src as (select mmsi, t_us, sog, lat, lon from {{ais}}),""" + p.runs_sql("lt_src", "sog>5.0e0", "avg(sog) mean_sog, min(lat) y0, max(lat) y1, min(lon) x0, max(lon) x1", "lt") + """,
b as (select * from (select *, row_number() over (partition by mmsi order by last_true-run_start desc, run_start) k from lt) q where k=1)
select b.mmsi, vt vessel_type, round((last_true-run_start)/3.6e9,10) run_hours, round(mean_sog,4) mean_sog, round((last_true-run_start)/1.0e6*mean_sog*(1.0e0+coalesce(length_m,0.0e0)/100.0e0),2) exposure
from b join m on m.mmsi=b.mmsi join n on n.mmsi=b.mmsi where c>=30 and regexp_matches(vt,'Tanker|Cargo|Towing') and last_true-run_start>=3600000000
 and x0>68.0e0+0.12e0*5.0e0 and x1<73.0e0-0.12e0*5.0e0 and y0>15.0e0+0.12e0*5.0e0 and y1<20.0e0-0.12e0*5.0e0""",
}
