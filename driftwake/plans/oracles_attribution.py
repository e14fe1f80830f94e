"""Oracle SQL for environment, envelope, release and ranking queries."""

from __future__ import annotations

from driftwake.plans import oracle_parts as p
from driftwake.plans import oracles_vessel as ov

_PIECES = """
pieces as (select mmsi, coalesce(lag(t_us) over w,t_us) t0, t_us t1, coalesce(lag(lat) over w,lat) lat0, lat lat1, coalesce(lag(lon) over w,lon) lon0, lon lon1,
  coalesce(lag(sog) over w,sog) sog0, sog sog1 from {ais} window w as (partition by mmsi order by t_us))"""
_F = "(case when t1>t0 then (ts-t0)/(t1-t0) else 0.0e0 end)"
_LIVE = "(ts>t0 or t0=t1)"
HITS = _PIECES + """,
probes as (select incident_id, hours_back, t_us+off*60000000 ts, off_rank, cx, cy, r from {steps} cross join (values (0,-30),(1,-15),(2,0),(3,15),(4,30)) o(off_rank,off)),
near as (select * from (select incident_id, hours_back, off_rank, ts, cx, cy, r, mmsi, lon0+(lon1-lon0)*""" + _F + """ lon, lat0+(lat1-lat0)*""" + _F + """ lat, sog0+(sog1-sog0)*""" + _F + """ sog
  from probes join pieces on ts>=t0 and ts<=t1 where """ + _LIVE + """) q where abs(lon-cx)<=r+0.001e0 and abs(lat-cy)<=r+0.001e0),
inside as (select n.incident_id, n.hours_back, n.mmsi, n.off_rank, any_value(n.ts) ts, any_value(lat) lat, any_value(lon) lon, any_value(sog) sog
  from near n join {step_edges} e on e.incident_id=n.incident_id and e.hours_back=n.hours_back group by n.incident_id, n.hours_back, n.mmsi, n.off_rank
  having sum(case when (y1>lat)<>(y2>lat) and lon<(x2-x1)*(lat-y1)/(y2-y1)+x1 then 1 else 0 end)%2=1),
hits as (select * from (select *, row_number() over (partition by incident_id, hours_back, mmsi order by off_rank) k from inside) q where k=1),
cands as (select incident_id, mmsi, count(*) n_hits, count(*) filter (where sog>=1) underway_hits, min(ts) first_hit_us, max(ts) last_hit_us, min(hours_back) min_hours_back, max(hours_back) max_hours_back from hits group by incident_id, mmsi),
top as (select * from (select *, row_number() over (partition by incident_id order by underway_hits desc, n_hits desc, mmsi) cand_rank from cands) q where cand_rank<=12)"""
SCENE = """
scene as (select distinct incident_id, mmsi from {ais} join {incidents} i on lon between cx-0.8e0 and cx+0.8e0 and lat between cy-0.8e0 and cy+0.8e0 and t_us between acq_us-64800000000 and acq_us)"""
SCORED = """
sc as (select *, exp(-offset_km/10.0e0) centroid_term, greatest(0.0e0,least(1.0e0,cos(radians(delta_deg)))) orientation_term from {hyps}),
sco as (select *, 0.4e0*iou+0.25e0*centroid_term+0.25e0*orientation_term+0.1e0*area_ratio score from sc)"""
BEST = SCORED + """,
hr as (select *, row_number() over (partition by incident_id, mmsi order by score desc, k) hyp_rank from sco),
best as (select hr.* from hr join top using (incident_id, mmsi) where hyp_rank=1)"""
GAPS = """
gp as (select mmsi, pt, t_us from (select mmsi, t_us, lag(t_us) over (partition by mmsi order by t_us) pt from {ais}) q where t_us-pt>900000000),
gapc as (select distinct b.incident_id, b.mmsi from best b join gp g on g.mmsi=b.mmsi and g.pt<=b.release_us+7200000000 and g.t_us>=b.release_us-7200000000)"""
_RISK = "case " + " ".join(f"when contains(lower(vt),'{k}') then {v}e0" for k, v in (
    ("tanker", 1.4), ("bulk", 1.25), ("container", 1.0), ("cargo", 1.1), ("tug", 0.85), ("fishing", 0.7))) + " else 1.0e0 end"
RANKED = f"""
vt as (select mmsi, {ov.TYPE_SQL} vt from first_fix),
r0 as (select b.*, vt.vt, coalesce(s.trust_prior,1.0e0) trust_prior, coalesce(bp.bprior,1.0e0) behaviour_prior, {_RISK} type_risk_prior, g.mmsi is not null gap_coincidence, coalesce(o.n_offences,0) prior_offences,
  exp((b.score-max(b.score) over (partition by b.incident_id))/0.25e0) e
  from best b left join scored s on s.mmsi=b.mmsi left join bp on bp.mmsi=b.mmsi left join vt on vt.mmsi=b.mmsi left join gapc g on g.incident_id=b.incident_id and g.mmsi=b.mmsi left join {{offences}} o on o.mmsi=b.mmsi),
r1 as (select *, e/sum(e) over (partition by incident_id) likelihood from r0),
r2 as (select *, likelihood*trust_prior*behaviour_prior*type_risk_prior*(case when gap_coincidence then 1.8e0 else 1.0e0 end)*(1.0e0+0.4e0*prior_offences) raw from r1),
r3 as (select *, raw/sum(raw) over (partition by incident_id) posterior from r2),
ranked as (select *, row_number() over (partition by incident_id order by posterior desc, mmsi) as rank from r3)"""
FULL = "with recursive " + ov.ALL_PRIORS + "," + HITS + "," + BEST + "," + GAPS + "," + RANKED
#: The same over every candidate of an incident.
EVERY = FULL.replace("hr join top using", "hr join cands using")
_ENVF = """
em as (select field_id, avg(wind_u) mu, avg(wind_v) mv from {env} group by field_id),
ef as (select e.field_id, ti, yi, xi, t_us, lat, lon, coalesce(wind_u,mu) wind_u, coalesce(wind_v,mv) wind_v, curr_u, curr_v from {env} e join em using (field_id))"""
_PROBE = """
pr as (select incident_id field_id, hours_back, t_us+600000000 ts, cy lat, cx lon from {steps}),
ax as (select distinct field_id, ti, t_us from {env}),
pt as (select pr.field_id, pr.hours_back, pr.ts, pr.lat, pr.lon, coalesce(min(ax.ti) filter (where ax.t_us>=ts), max(ax.ti)) ti from pr join ax using (field_id) group by all)"""
_SAMPLE = _ENVF + "," + _PROBE + """,
g0 as (select field_id, min(lat) y0, min(lon) x0 from {env} group by field_id),
gi as (select pt.*, least(7,greatest(0,floor((lat-y0)/0.5e0))) yi, least(7,greatest(0,floor((lon-x0)/0.5e0))) xi, y0, x0 from pt join g0 using (field_id)),
gw as (select *, least(1.0e0,greatest(0.0e0,(lat-y0)/0.5e0-yi)) wy, least(1.0e0,greatest(0.0e0,(lon-x0)/0.5e0-xi)) wx from gi),
smp as (select gw.field_id, hours_back, gw.ts, gw.lat, gw.lon, """ + ",".join(
    f"sum(ef.{v}*(case when ef.yi=gw.yi then 1-wy else wy end)*(case when ef.xi=gw.xi then 1-wx else wx end)) {v}" for v in ("wind_u", "wind_v", "curr_u", "curr_v")) + """
  from gw join ef on ef.field_id=gw.field_id and ef.ti=gw.ti and ef.yi between gw.yi and gw.yi+1 and ef.xi between gw.xi and gw.xi+1 group by gw.field_id, hours_back, gw.ts, gw.lat, gw.lon),
drift as (select *, curr_u+0.03e0*(wind_u*cos(radians(15.0e0))+wind_v*sin(radians(15.0e0))) drift_u, curr_v+0.03e0*(wind_v*cos(radians(15.0e0))-wind_u*sin(radians(15.0e0))) drift_v from smp)"""
_RELEASES = HITS + """,
span as (select mmsi, min(t_us) a, max(t_us) z from {ais} group by mmsi),
lh as (select t.incident_id, t.mmsi, i.acq_us, greatest(first_hit_us-7200000000,a) lo, least(last_hit_us+7200000000,z,i.acq_us-3600000000) hi from top t join span using (mmsi) join {incidents} i on i.incident_id=t.incident_id),
rel as (select incident_id, mmsi, acq_us, k, lo+k*1800000000 ts from (select *, unnest(range(0,(hi-lo)//1800000000+1)) k from lh where hi>lo) q),
relp as (select incident_id, rel.mmsi, k, ts, acq_us, lat0+(lat1-lat0)*""" + _F + """ lat, lon0+(lon1-lon0)*""" + _F + """ lon from rel join pieces s on s.mmsi=rel.mmsi and ts>=t0 and ts<=t1 where """ + _LIVE + ")"

ORACLES: dict[str, str] = {
    "position_at": "with " + _PIECES + """,
pr as (select mmsi, cast(h as bigint) as hour_idx, (select min(t_us) from {ais})+h*3600000000 ts from (select distinct mmsi from {ais}) v cross join unnest(range(0,13)) as g(h))
select pr.mmsi, hour_idx, ts ts_us, round(lat0+(lat1-lat0)*""" + _F + ",6) lat, round(lon0+(lon1-lon0)*" + _F + ",6) lon, round(sog0+(sog1-sog0)*" + _F
        + ",6) sog from pr join pieces s on s.mmsi=pr.mmsi and ts>=t0 and ts<=t1 where " + _LIVE,
    "envelope_hits": "with " + HITS + " select incident_id, hours_back, mmsi, ts hit_us, round(lat,6) lat, round(lon,6) lon, round(sog,6) sog from hits",
    "candidate_rollup": "with " + HITS + " select * from cands",
    "top_candidates": "with " + HITS + " select incident_id, mmsi, n_hits, underway_hits, cand_rank from top",
    "in_scene": "with " + SCENE + " select incident_id, mmsi from scene",
    "funnel": "with " + HITS + "," + SCENE + "," + BEST + """,
u as (select incident_id, 's' s from scene union all select incident_id, 'e' from cands union all select incident_id, 'u' from cands where underway_hits>0 union all select incident_id, 'c' from top union all select incident_id, 'r' from best)
select incident_id, count(*) filter (where s='s') total_in_scene, count(*) filter (where s='e') in_envelope, count(*) filter (where s='u') in_envelope_underway, count(*) filter (where s='c') scored, count(*) filter (where s='r') ranked from u group by incident_id""",
    "release_hypotheses": "with " + _RELEASES + " select incident_id, mmsi, k, ts release_us, round(lat,6) release_lat, round(lon,6) release_lon, round((acq_us-ts)/3.6e9,10) age_hours from relp",
    "score_terms": "with " + SCORED + " select incident_id, mmsi, k, round(centroid_term,6) centroid_term, round(orientation_term,6) orientation_term, round(score,6) score from sco",
    "best_hypothesis": "with " + SCORED + ", hr as (select *, row_number() over (partition by incident_id, mmsi order by score desc, k) hyp_rank from sco) select incident_id, mmsi, k, release_us, round(score,6) score from hr where hyp_rank=1",
    "top3_hypotheses": "with " + SCORED + ", hr as (select *, row_number() over (partition by incident_id, mmsi order by score desc, k) hyp_rank from sco) select incident_id, mmsi, k, round(score,6) score, hyp_rank from hr where hyp_rank<=3",
    "gap_coincidence": "with " + HITS + "," + BEST + "," + GAPS + " select incident_id, mmsi from gapc",
    "posterior_rank": EVERY + " select incident_id, mmsi, rank, round(score,6) score, round(likelihood,6) likelihood, trust_prior, round(behaviour_prior,6) behaviour_prior, type_risk_prior, gap_coincidence, prior_offences, round(posterior,6) posterior from ranked",
    "slick_age": FULL + """,
t3 as (select hr.incident_id, hr.mmsi, hr.hyp_rank, (i.acq_us-hr.release_us)/3.6e9 age, i.area_km2 from hr join ranked r on r.incident_id=hr.incident_id and r.mmsi=hr.mmsi and r.rank=1 join {incidents} i on i.incident_id=hr.incident_id where hr.hyp_rank<=3),
a as (select incident_id, max(mmsi) mmsi, arg_min(age,hyp_rank) best_hours, min(age) low_hours, max(age) high_hours, max(area_km2) area_km2 from t3 group by incident_id),
f as (select *, case when area_km2>0 then pow(area_km2/18.0e0,1.0e0/0.75e0) end fay_hours from a)
select incident_id, mmsi, round(best_hours,10) best_hours, round(low_hours,10) low_hours, round(high_hours,10) high_hours, area_km2, round(fay_hours,6) fay_hours, round(case when best_hours>0 then fay_hours/best_hours end,6) fay_ratio, coalesce(case when best_hours>0 then fay_hours/best_hours end between 0.5e0 and 2.0e0,false) agrees from f""",
    "rationale": FULL + """
select r.incident_id, r.mmsi, concat_ws(' | ', printf('Track met the origin area in %d hourly steps (%d to %d h before the image).', n_hits, min_hours_back, max_hours_back),
 concat('Best release time ', strftime(make_timestamp(release_us),'%Y-%m-%d %H:%M UTC'), printf(' covers %.0f%% of slick and model together.', iou*100)),
 printf('Centres differ by %.1f km.', offset_km), printf('Course and slick axis: %.0f degrees apart.', delta_deg),
 printf('Areas differ by a factor of %.2f.', 1/greatest(area_ratio,1e-6)), case when vt is not null then printf('Reported type: %s.', vt) end,
 case when gap_coincidence then 'No reports near the release time.' end, case when prior_offences>0 then printf('Earlier offences on file: %d.', prior_offences) end,
 case when abs(trust_prior-1)>1e-9 then printf('Weight %s for trust (%.2fx).', case when trust_prior>1 then 'raised' else 'lowered' end, trust_prior) end,
 case when abs(behaviour_prior-1)>1e-9 then printf('Weight %s for behaviour (%.2fx).', case when behaviour_prior>1 then 'raised' else 'lowered' end, round(behaviour_prior,9)) end,
 case when abs(type_risk_prior-1)>1e-9 then printf('Weight %s for vessel-type risk (%.2fx).', case when type_risk_prior>1 then 'raised' else 'lowered' end, type_risk_prior) end) rationale
from ranked r join cands c on c.incident_id=r.incident_id and c.mmsi=r.mmsi""",
    "wind_statistics": "select field_id, round(avg(s),6) mean_speed_ms, round(min(s),6) min_speed_ms, round(max(s),6) max_speed_ms, round(avg(case when wind_u is null then 1.0e0 else 0.0e0 end),6) missing_fraction, round(avg(case when s between 3 and 10 then 1.0e0 when s is not null then 0.0e0 end),6) fraction_in_band from (select *, sqrt(wind_u*wind_u+wind_v*wind_v) s from {env}) q group by field_id",
    "wind_fill": "with " + _ENVF + " select field_id, ti, yi, xi, round(wind_u,6) wind_u, round(wind_v,6) wind_v from ef",
    "env_summary": "with " + _ENVF + """,
ins as (select incident_id field_id, acq_us ts_us from {incidents}), ax as (select distinct field_id, ti, t_us from {env}),
pk as (select ins.field_id, ts_us, coalesce(min(ax.ti) filter (where ax.t_us>=ts_us), max(ax.ti)) ti from ins join ax using (field_id) group by ins.field_id, ts_us),
m as (select pk.field_id, ts_us, avg(wind_u) wu, avg(wind_v) wv, avg(curr_u) cu, avg(curr_v) cv, avg(sqrt(wind_u*wind_u+wind_v*wind_v)) ws, avg(sqrt(curr_u*curr_u+curr_v*curr_v)) cs from pk join ef on ef.field_id=pk.field_id and ef.ti=pk.ti group by pk.field_id, ts_us)
select field_id, ts_us, round(ws,6) mean_wind_speed_ms, round(mod(degrees(atan2(wu,wv))+360.0e0,360.0e0),6) wind_toward_deg, round(cs,6) mean_current_speed_ms, round(mod(degrees(atan2(cu,cv))+360.0e0,360.0e0),6) current_toward_deg, ws between 3 and 10 wind_gate_pass from m""",
    "env_sample": "with " + _SAMPLE + " select field_id, hours_back, round(wind_u,6) wind_u, round(wind_v,6) wind_v, round(curr_u,6) curr_u, round(curr_v,6) curr_v, round(drift_u,6) drift_u, round(drift_v,6) drift_v from drift",
    "drift_advection": "with " + _SAMPLE + f" select field_id, hours_back, round(lat+drift_v*hours_back*3600.0e0/{p.lat_m('lat')},6) end_lat, round(lon+drift_u*hours_back*3600.0e0/{p.lon_m('lat')},6) end_lon from drift",
    "env_thinned": "select field_id, ti, yi, xi, cast(round(cast(wind_u as decimal(18,6)),3) as double) wind_u, cast(round(cast(wind_v as decimal(18,6)),3) as double) wind_v, cast(round(cast(curr_u as decimal(18,6)),3) as double) curr_u, cast(round(cast(curr_v as decimal(18,6)),3) as double) curr_v from {env} where yi%3=0 and xi%3=0 and ti%2=0",
    "granule_scan": """
select granule, t_us, lat, lon, case when abs(u+999000000.0e0)>=1 then u end u, case when abs(v+999000000.0e0)>=1 then v end v
from (select event_id//500 granule, 946684800000000+(event_id%720)*3600000000 t_us, round(-30.0e0+(event_id*7%600)/10.0e0,1) lat,
  case when (event_id*13%3600)/10.0e0>180 then (event_id*13%3600)/10.0e0-360.0e0 else (event_id*13%3600)/10.0e0 end lon, (event_id*13%3600)/10.0e0 lon360,
  case when event_id%19=0 then -999000000.0e0 else value end u, case when event_id%19=0 then -999000000.0e0 else value/2 end v from events) q
where lat between -20.0e0 and 10.0e0 and lon360 between 150.0e0 and 210.0e0""",
}
