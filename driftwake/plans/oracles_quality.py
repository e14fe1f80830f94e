"""Oracle SQL for baseline, evaluation, matching, custody, catalogue, calibration and detectability queries."""

from __future__ import annotations

from driftwake.operators.detectability import SENSORS
from driftwake.operators.evaluation import BANDS, THRESHOLDS
from driftwake.plans import oracle_parts as p

_BIN = "case when wind_ms<0 then '10+' when wind_ms<3 then '0-3' when wind_ms<5 then '3-5' when wind_ms<7 then '5-7' when wind_ms<10 then '7-10' else '10+' end"
_STATS = f"""
st as (select cell, {_BIN} wind_bin, count(*) n, count(distinct scene_id) scenes, sum(v)/count(*) mean, sqrt(greatest(sum(v*v)/count(*)-pow(sum(v)/count(*),2),1e-9)) std from {{sigma0}} group by all),
md as (select scene_id, median(v) med from {{sigma0}} group by scene_id),
bg as (select s.scene_id, any_value(med) med, median(abs(v-med))*1.4826e0 mad from {{sigma0}} s join md on md.scene_id=s.scene_id group by s.scene_id),
zz as (select s.scene_id, s.cell, s.wind_ms, s.v, s.l_orderkey, s.line, {_BIN.replace('wind_ms', 's.wind_ms')} wind_bin, case when st.mean is not null then (v-st.mean)/greatest(st.std,1e-6) else (v-bg.med)/greatest(bg.mad,1e-6) end z,
  case when st.mean is not null then 'local' else 'global_fallback' end "mode" from {{sigma0}} s left join st on st.cell=s.cell and st.wind_bin={_BIN.replace('wind_ms', 's.wind_ms')} and st.scenes>=15 join bg on bg.scene_id=s.scene_id),
fz as (select *, (l_orderkey%100)/100.0e0*(1.0e0/(1.0e0+exp(-greatest(-50.0e0,least(50.0e0,-z-1.5e0)))))*(case when wind_ms between 3 and 10 then 1.0e0 else 0.0e0 end) confidence from zz)"""
_CONF = "count(*) filter (where target=0 and pred=0) tn, count(*) filter (where target=0 and pred=1) fp, count(*) filter (where target=1 and pred=0) fn, count(*) filter (where target=1 and pred=1) tp"
_MET = """coalesce(tp/nullif(tp+fp+fn,0),0.0e0) oil_iou, coalesce(2*tp/nullif(2*tp+fp+fn,0),0.0e0) oil_dice, coalesce(tp/nullif(tp+fp,0),0.0e0) oil_precision, coalesce(tp/nullif(tp+fn,0),0.0e0) oil_recall,
 coalesce(2*tp/nullif(2*tp+fp+fn,0)*(case when tp+fp>0 and tp+fn>0 and tp>0 then 1 end),0.0e0) oil_f1, coalesce(tn/nullif(tn+fp+fn,0),0.0e0) background_iou,
 (coalesce(tp/nullif(tp+fp+fn,0),0)+coalesce(tn/nullif(tn+fp+fn,0),0))/((case when tp+fp+fn>0 then 1 else 0 end)+(case when tn+fp+fn>0 then 1 else 0 end)) mean_iou,
 (coalesce(2*tp/nullif(2*tp+fp+fn,0),0)+coalesce(2*tn/nullif(2*tn+fp+fn,0),0))/((case when tp+fp+fn>0 then 1 else 0 end)+(case when tn+fp+fn>0 then 1 else 0 end)) mean_dice, (tp+tn)/(tp+tn+fp+fn) pixel_accuracy"""
_NAMES = ("oil_iou", "oil_dice", "oil_precision", "oil_recall", "oil_f1", "background_iou", "mean_iou", "mean_dice", "pixel_accuracy")
_ROUND = ", ".join(f"round({m},6) {m}" for m in _NAMES)
_SENSOR = """
c0 as (select *, case when prob_a>=0.5e0 then 1 else 0 end pred from {chips}),
cf as (select coalesce(sensor,'ALL') sensor, """ + _CONF + """ from c0 group by grouping sets ((),(sensor)))"""
_BAND = "case when oil_fraction=0 then 'empty' " + " ".join(f"when oil_fraction<={u}e0 then '{n}'" for n, u, _ in BANDS[1:]) + " end"
_TARGET = "case band " + " ".join(f"when '{n}' then {t}e0" for n, _, t in BANDS) + " end"
_BANDS = f"""
bn as (select *, {_BAND} band from {{chips}}), bc as (select band, count(*) chips, {_TARGET} t from bn group by band),
br as (select band, chips, chips/sum(chips) over () natural_share, t/sum(t) over () sampled_share, t/sum(t) over ()/greatest(chips/sum(chips) over (),1e-9) boost, t/sum(t) over ()/chips weight from bc)"""
_PAIR = "pr as (select chip_id, case when target=1 then prob_a else 1.0e0-prob_a end iou_a, case when target=1 then prob_b else 1.0e0-prob_b end iou_b, (case when target=1 then prob_b else 1.0e0-prob_b end)-(case when target=1 then prob_a else 1.0e0-prob_a end) delta from {chips})"
_BUCKET = "cast(concat('0x',substr(sha1(concat(sensor,'/',cast(chip_id as varchar))),1,8)) as bigint)%1000"
_POS = """
tt as (select min(t_us)+21600000000 t from {ais}),
sg as (select mmsi, coalesce(lag(t_us) over w,t_us) t0, t_us t1, coalesce(lag(lat) over w,lat) lat0, lat lat1, coalesce(lag(lon) over w,lon) lon0, lon lon1 from {ais} window w as (partition by mmsi order by t_us)),
ps as (select mmsi id, lat0+(lat1-lat0)*(case when t1>t0 then (t-t0)/(t1-t0) else 0.0e0 end) lat, lon0+(lon1-lon0)*(case when t1>t0 then (t-t0)/(t1-t0) else 0.0e0 end) lon from sg cross join tt where t>=t0 and t<=t1 and (t>t0 or t0=t1)),
nn as (select a.id, a.lat, a.lon, min(""" + p.dist_m("a.lat", "a.lon", "b.lat", "b.lon") + """/1000.0e0) km from ps a join ps b on a.id<>b.id group by a.id, a.lat, a.lon)"""
_PAIRS = """
sg as (select mmsi, coalesce(lag(t_us) over w,t_us) t0, t_us t1, coalesce(lag(lat) over w,lat) lat0, lat lat1, coalesce(lag(lon) over w,lon) lon0, lon lon1 from {ais} window w as (partition by mmsi order by t_us)),
gp as (select target_id, mmsi, """ + p.dist_m("tlat", "tlon", "lat", "lon") + """/1000.0e0 km from (select target_id, t.lat tlat, t.lon tlon, mmsi, lat0+(lat1-lat0)*(case when t1>t0 then (t_us-t0)/(t1-t0) else 0.0e0 end) lat,
   lon0+(lon1-lon0)*(case when t1>t0 then (t_us-t0)/(t1-t0) else 0.0e0 end) lon from {targets} t join sg on t_us>=t0 and t_us<=t1 and (t_us>t0 or t0=t1)) q),
ga as (select *, row_number() over (partition by target_id order by km, mmsi) rt, row_number() over (partition by mmsi order by km, target_id) rv from gp where km<=2.0e0),
mt as (select target_id, mmsi, km from ga where rt=1 and rv=1)"""
_CELLS = "cells(a,c,r) as (select area_km2, contrast_db, round(least(1.0e0, greatest(0.0e0, 0.1e0*k+0.08e0*contrast_db-0.35e0)),3) from (values (0,0.005e0),(1,0.01e0),(2,0.02e0),(3,0.05e0),(4,0.1e0),(5,0.25e0),(6,0.5e0),(7,1.0e0),(8,2.5e0)) x(k,area_km2) cross join (values (1.0e0),(2.0e0),(3.0e0),(5.0e0),(8.0e0),(12.0e0)) y(contrast_db))"
_SENS = "(values " + ",".join(f"('{n}',{x}e0,{r}e0,{str(s).lower()},{str(d).lower()})" for n, x, r, s, d in SENSORS) + ") s(sensor,pixel_m,revisit_h,sky,day)"
_ASSESS = _CELLS + """,
hit as (select request_id, r from (select request_id, r, row_number() over (partition by request_id order by abs(log10(a)-log10(greatest(least(area_km2,2.5e0),1e-6))), abs(c-contrast_db), a, c) k from {requests} cross join cells) q where k=1),
a0 as (select q.*, s.*, h.r, area_km2*1.0e6/(pixel_m*pixel_m) px, (case when sky then greatest(0.0e0,1.0e0-cloud_fraction) else 1.0e0 end)*(case when day then greatest(0.0e0,daylight_fraction) else 1.0e0 end) usable from {requests} q cross join """ + _SENS + """ join hit h on h.request_id=q.request_id),
a1 as (select *, usable*(case when sensor='EOS-04' then r else case when px>=10 then 1.0e0 else 0.0e0 end end) eff from a0),
a2 as (select *, case when px>=10 and eff>0 then revisit_h/2.0e0/eff end w from a1)"""
_SUN = "degrees(asin(greatest(-1.0e0,least(1.0e0,sin(radians(lat))*sin(radians(dec))+cos(radians(lat))*cos(radians(dec))*cos(radians((hh+lon/15.0e0-12.0e0)*15.0e0))))))"


def _sun(t: str, alias: str) -> str:
    return (f"(select scene_id, {_SUN} {alias} from (select scene_id, lat, lon, 23.44e0*sin(radians(360.0e0*(284+dayofyear(make_timestamp({t})))/365.0e0)) dec, "
            f"({t}-({t}//86400000000)*86400000000)/3.6e9 hh from {{calibration}}) q)")


ORACLES: dict[str, str] = {
    "baseline_fold": f"select scene_id, cell, {_BIN} wind_bin, count(*) n, round(sum(v),4) s, round(sum(v*v),4) ss from {{sigma0}} group by all",
    "baseline_stats": "with " + _STATS + " select cell, wind_bin, n, scenes, round(mean,6) mean, round(std,5) std from st",
    "robust_background": "with " + _STATS + " select scene_id, round(med,6) median_db, round(mad,6) sigma_db from bg",
    "baseline_z": "with " + _STATS + ' select scene_id, cell, wind_bin, v, round(z,4) z, "mode" from zz',
    "fused_confidence": "with " + _STATS + " select scene_id, cell, v, round(confidence,5) confidence from fz",
    "anomaly_summary": "with " + _STATS + " select scene_id, round(avg(case when confidence>=0.3e0 then 1.0e0 else 0.0e0 end),6) masked_share, round(coalesce(avg(confidence) filter (where confidence>=0.3e0),0.0e0),5) mean_in_mask, round(max(confidence),5) max_confidence from fz group by scene_id",
    "wind_gate_share": "select scene_id, round(min(wind_ms),6) wind_min_ms, round(max(wind_ms),6) wind_max_ms, round(avg(wind_ms),6) wind_mean_ms, round(avg(case when wind_ms between 3 and 10 then 1.0e0 else 0.0e0 end),6) fraction_in_band from {sigma0} group by scene_id",
    "confusion_by_sensor": "with " + _SENSOR + " select * from cf",
    "metrics_by_sensor": "with " + _SENSOR + f", m as (select sensor, {_MET} from cf) select sensor, {_ROUND} from m",
    "threshold_sweep": "with t as (select *, case when prob_a>=th then 1 else 0 end pred from {chips} cross join (values " + ",".join(f"({t}e0)" for t in THRESHOLDS)
        + f") v(th)), cf as (select th threshold, {_CONF} from t group by th), m as (select threshold, {_MET} from cf) select threshold, {_ROUND}, row_number() over (order by oil_iou desc, threshold)=1 is_best from m",
    "run_comparison": f"with a as (select {_MET} from (select {_CONF} from (select *, case when prob_a>=0.5e0 then 1 else 0 end pred from {{chips}}) q) c), b as (select {_MET} from (select {_CONF} from (select *, case when prob_b>=0.5e0 then 1 else 0 end pred from {{chips}}) q) c) "
        + " union all ".join(f"select '{m}' metric, round(a.{m},6) before, round(b.{m},6) as after, round(b.{m}-a.{m},6) delta from a, b" for m in _NAMES),
    "paired_delta_summary": "with " + _PAIR + " select count(*) chips, count(*) filter (where delta>0.01e0) improved, count(*) filter (where delta<-0.01e0) regressed, count(*) filter (where abs(delta)<=0.01e0) unchanged, round(avg(iou_a),6) mean_before, round(avg(iou_b),6) mean_after from pr",
    "best_and_worst": "with " + _PAIR + " select chip_id, round(delta,6) delta, 'best' side from (select * from pr order by delta desc, chip_id limit 5) a union all select chip_id, round(delta,6), 'worst' from (select * from pr order by delta, chip_id limit 5) b",
    "band_report": "with " + _BANDS + " select band, chips, round(natural_share,6) natural_share, round(sampled_share,6) sampled_share, round(boost,6) boost, round(weight,9) weight from br",
    "band_weights": "with " + _BANDS + " select chip_id, bn.band, round(weight,9) weight from bn join br on br.band=bn.band",
    "weighted_fraction": "with " + _BANDS + " select round(sum(oil_fraction*weight)/sum(weight),6) weighted_fraction, round(avg(oil_fraction),6) mean_fraction from bn join br on br.band=bn.band",
    "split_bucket": f"select chip_id, sensor, {_BUCKET} bucket, case when {_BUCKET}<800 then 'train' else 'val' end split from {{chips}}",
    "split_overlap": f"select count(*) filter (where {_BUCKET}<800) n_train, count(*) filter (where {_BUCKET}>=800) n_val, cast(0 as bigint) overlap from {{chips}}",
    "stratified_subset": "select chip_id, sensor from (select *, row_number() over (partition by sensor order by sha256(cast(chip_id as varchar)), chip_id) rn from {chips}) q where rn<=greatest(1,40//(select count(distinct sensor) from {chips}))",
    "detection_surface": "select area_km2, contrast_db, count(*) trials, round(avg(h),6) detection_rate, round(avg(iou),6) mean_iou from (select p_size area_km2, p_partkey%6+1.0e0 contrast_db, case when (p_partkey*7919)%100<p_size+10*(p_partkey%6) then 1.0e0 else 0.0e0 end h, ((p_partkey*31)%100)/100.0e0 iou from part) q group by area_km2, contrast_db",
    "headline_minima": "with s as (select cast(p_size as bigint) area_km2, p_partkey%6+1.0e0 contrast_db, avg(case when (p_partkey*7919)%100<p_size+10*(p_partkey%6) then 1.0e0 else 0.0e0 end) rate from part group by p_size, p_partkey%6) select min(area_km2) filter (where rate>=0.8e0) smallest_area_km2, min(contrast_db) filter (where rate>=0.8e0) faintest_contrast_db from s",
    "nearest_vessel": "with " + _POS + " select id, round(lat,6) lat, round(lon,6) lon, round(km,4) km from nn",
    "neighbour_distribution": "with " + _POS + " select count(*) n, round(quantile_cont(km,0.25),4) p25_km, round(quantile_cont(km,0.5),4) p50_km, round(quantile_cont(km,0.95),4) p95_km, round(max(km),4) max_km, quantile_cont(km,0.95)>4*quantile_cont(km,0.25) bimodal from nn",
    "sar_ais_match": "with " + _PAIRS + " select target_id, mmsi, round(km,4) km, 'MATCHED' classification from mt union all select target_id, null, null, 'DARK' from {targets} where target_id not in (select target_id from mt) union all select distinct cast(null as bigint), mmsi, cast(null as double), 'PHANTOM' from {ais} where mmsi not in (select mmsi from mt)",
    "audit_links": "with l as (select *, lag(chain_hash) over (order by seq) ph from {audit}) select seq, incident_id, prev_hash from l where coalesce(ph,'0')<>prev_hash",
    "audit_bodies": "select seq, incident_id from {audit} where sha256(body)<>chain_hash",
    "audit_newest": "select incident_id, max(seq) seq, arg_max(chain_hash,seq) chain_hash, count(*) entries from {audit} group by incident_id",
    "digest_verify": "with rec as (select o_custkey incident_id, cast(o_orderkey as varchar) \"name\", sha256(cast(floor(o_totalprice) as varchar)) d from orders where o_orderkey%10<>1), act as (select o_custkey incident_id, cast(o_orderkey as varchar) \"name\", sha256(cast(floor(o_totalprice) as varchar)) d, o_orderkey%7 k from orders where o_orderkey%10<>2), act2 as (select incident_id, \"name\", case when k=3 then 'x' else d end d from act) select coalesce(r.incident_id,a.incident_id) incident_id, coalesce(r.\"name\",a.\"name\") \"name\", case when a.d is null then 'missing' when r.d is null then 'unrecorded' when a.d<>r.d then 'differs' else 'ok' end status from rec r full join act2 a on r.incident_id=a.incident_id and r.\"name\"=a.\"name\"",
    "catalogue_new": "select observation_id, \"mode\", product, acquired_us, pixels_local from {observations} where not (regexp_extract(observation_id,'[0-9]+')::bigint in (select page_id from pages where length(html)%2=0))",
    "catalogue_modes": "select \"mode\", count(*) n, count(*) filter (where acquired_us is null) undated, count(*) filter (where pixels_local) with_pixels from {observations} group by \"mode\"",
    "detectability": "with " + _ASSESS + " select request_id, sensor, round(px,4) pixels_on_target, px>=10 resolves, round(usable,6) usable_pass_fraction, case when sensor='EOS-04' then r end measured_rate, round(w,6) wait_h, coalesce(w<=persistence_hours,false) caught, round(least(1.0e0,persistence_hours/w)*(case when w is not null then 1 end),6) catch_probability, case when px<10 then 'CANNOT SEE IT' when w is null then 'BLOCKED' when w<=persistence_hours then 'DETECTS' else 'MISSES MOST' end verdict from a2",
    "first_detection": "with " + _ASSESS + """,
a3 as (select *, w<=persistence_hours caught, persistence_hours/w cp from a2),
fw as (select request_id, sensor, w from (select *, row_number() over (partition by request_id order by w, sensor) k from a3 where caught) q where k=1),
be as (select request_id, sensor, least(1.0e0,cp) cp from (select *, row_number() over (partition by request_id order by least(1.0e0,cp) desc, sensor desc) k from a3 where w is not null) q where k=1)
select r.request_id, fw.sensor first_sensor, round(fw.w,6) first_wait_h, case when fw.sensor is null then be.sensor end best_effort, round(case when fw.sensor is null then be.cp end,6) best_effort_probability from {requests} r left join fw on fw.request_id=r.request_id left join be on be.request_id=r.request_id""",
    "size_classes": "select request_id, case when area_km2>=10 then 'large' when area_km2>=5 then 'medium' else 'small' end size_class from {requests}",
    "calibration_check": "select scene_id, round(abs((k_sigma-k_beta)+10.0e0*log10(sin(radians(incidence_deg)))),4) beta_residual_db, round(abs((k_sigma-k_gamma)+10.0e0*log10(cos(radians(incidence_deg)))),4) gamma_residual_db, abs((k_sigma-k_beta)+10.0e0*log10(sin(radians(incidence_deg))))<=0.05e0 and abs((k_sigma-k_gamma)+10.0e0*log10(cos(radians(incidence_deg))))<=0.05e0 is_consistent, round(10.0e0*log10(noise_bias)-k_sigma,6) nesz_db from {calibration}",
    "timestamp_zone_check": f"with u as {_sun('acq_us', 'e')}, i as {_sun('(acq_us-19800000000)', 'e')} select c.scene_id, round(u.e,4) as_utc_deg, round(i.e,4) as_ist_deg, abs(u.e-sun_elevation)<=3.0e0 and abs(u.e-sun_elevation)<abs(i.e-sun_elevation) is_utc from {{calibration}} c join u on u.scene_id=c.scene_id join i on i.scene_id=c.scene_id",
}
