"""Oracle SQL for polygon, shore, alert and serving queries."""

from __future__ import annotations

from driftwake.plans import oracle_parts as p
from driftwake.plans import oracles_attribution as oa

_EDGE = "e as (select a.slick_id, a.incident_id, a.k, a.x x1, a.y y1, b.x x2, b.y y2 from {slick_points} a join {slick_points} b on b.slick_id=a.slick_id and b.k=(a.k+1)%36)"
_MET = _EDGE + """,
o as (select slick_id, x ox, y oy from {slick_points} where k=0),
ct as (select e.slick_id, any_value(ox)+sum((x1-ox+x2-ox)*((x1-ox)*(y2-oy)-(x2-ox)*(y1-oy)))/(3*sum((x1-ox)*(y2-oy)-(x2-ox)*(y1-oy))) lon, any_value(oy)+sum((y1-oy+y2-oy)*((x1-ox)*(y2-oy)-(x2-ox)*(y1-oy)))/(3*sum((x1-ox)*(y2-oy)-(x2-ox)*(y1-oy))) lat from e join o using (slick_id) group by e.slick_id),
m as (select e.slick_id, k, (x1-lon)*""" + p.lon_m("lat") + " x1, (y1-lat)*" + p.lat_m("lat") + " y1, (x2-lon)*" + p.lon_m("lat") + " x2, (y2-lat)*" + p.lat_m("lat") + """ y2 from e join ct using (slick_id)),
ar as (select slick_id, abs(sum(x1*y2-x2*y1))/2 area, sum(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))) perim from m group by slick_id),
th as (select slick_id, k, atan2(y2-y1,x2-x1) th from m),
ex as (select t.slick_id, t.k, t.th, max(x1*cos(th)+y1*sin(th))-min(x1*cos(th)+y1*sin(th)) w, max(y1*cos(th)-x1*sin(th))-min(y1*cos(th)-x1*sin(th)) h from th t join m on m.slick_id=t.slick_id group by t.slick_id, t.k, t.th),
rc as (select *, row_number() over (partition by slick_id order by w*h, k) r from ex)"""
_COVER = """
cells as (select t, incident_id, unnest(range(cast(floor(x0/0.02e0) as bigint), cast(floor(x9/0.02e0) as bigint)+1)) cx, y0, y9 from (select t, incident_id, min(x1) x0, max(x1) x9, min(y1) y0, max(y1) y9 from ed group by t, incident_id) q),
cc as (select t, incident_id, cx, unnest(range(cast(floor(y0/0.02e0) as bigint), cast(floor(y9/0.02e0) as bigint)+1)) cy from cells),
inn as (select cc.t, cc.incident_id, cx, cy from cc join ed using (t, incident_id) group by all having sum(case when (y1>(cy+0.5e0)*0.02e0)<>(y2>(cy+0.5e0)*0.02e0) and (cx+0.5e0)*0.02e0<(x2-x1)*((cy+0.5e0)*0.02e0-y1)/(y2-y1)+x1 then 1 else 0 end)%2=1)"""
_AREA = p.lat_m("((cy+0.5e0)*0.02e0)") + "*" + p.lon_m("((cy+0.5e0)*0.02e0)") + "*0.0004e0/1.0e6"
_LAND = "land as (select distinct cast(floor(y1/0.02e0) as bigint) cy, unnest(range(cast(floor(x1/0.02e0) as bigint)+1, 3801)) cx from (select cast(floor(y1/0.02e0) as bigint)*0.02e0+0.01e0 y1, min(x1) x1 from {coast} group by cast(floor(y1/0.02e0) as bigint)) q)"
_ETA = """
hh as (select *, lag(distance_km,1) over w d1, lag(distance_km,2) over w d2, lag(horizon_hours,1) over w h1, lag(horizon_hours,2) over w h2, row_number() over w rn from {horizons} window w as (partition by incident_id order by horizon_hours)),
ft as (select * from (select *, row_number() over (partition by incident_id order by horizon_hours) k from hh where distance_km<=0) q where k=1),
im as (select h.incident_id, max(h.area_km2) area_km2, min(h.distance_km) closest_km, any_value(f.incident_id) is not null shore_contact,
  any_value(case when f.incident_id is null then null when f.rn=1 then 0.0e0 when f.rn>=3 and d2-d1>0 then least(h1+d1/((d2-d1)/(h1-h2)),f.horizon_hours) else (h1+f.horizon_hours)/2.0e0 end) eta_hours from {horizons} h left join ft f on f.incident_id=h.incident_id group by h.incident_id),
tr as (select *, greatest(case when area_km2>=150 then 3 when area_km2>=25 then 2 else 1 end, case when eta_hours<=24 then 3 when eta_hours<=72 then 2 else 1 end) tier from im)"""
_KM2 = "printf('%.1f', area_km2)"
_REASONS = f"""case when area_km2<25 and not coalesce(eta_hours<=72,false) then concat('oil over ',{_KM2},' km², stays offshore for 72 h', case when closest_km>0 then printf(' (nearest %.0f km)',closest_km) else '' end)
 else concat_ws('; ', case when area_km2>=25 then concat('oil over ',{_KM2},' km² ≥ 25 km²') end, case when area_km2>=150 then concat('oil over ',{_KM2},' km² ≥ 150 km²') end, case when eta_hours<=72 then printf('ashore in about %.0f h',eta_hours) end) end"""
_SEV = "case tier when 3 then 'EMERGENCY' when 2 then 'ALERT' else 'ADVISORY' end"
_RECIP = _ETA + """,
al as (select incident_id, tier, 8.0e0+(incident_id%130)/10.0e0 lat, 66.0e0+(incident_id%97)/8.0e0 lon from tr),
sc as (select a.incident_id, a.tier, s.station_id, role, region, round(""" + p.haversine("a.lat", "a.lon", "s.lat", "s.lon") + """,1) km, round(mod(""" + p.bearing("s.lat", "s.lon", "a.lat", "a.lon") + """,360.0e0),1) brg,
  case role when 'NATIONAL_HQ' then 0 when 'REGION_HQ' then 1 when 'DISTRICT_HQ' then 2 else 3 end rr from al a join {stations} s on s.tier_min<=a.tier),
lo as (select *, row_number() over (partition by incident_id order by km, station_id) k from sc where rr>=2),
ow as (select incident_id, region own from lo where k=1),
cm as (select sc.*, row_number() over (partition by sc.incident_id order by region<>own, rr, km, station_id) k from sc join ow using (incident_id) where rr<2),
nc as (select incident_id, count(*) c from cm where k<=2 group by incident_id),
out as (select lo.incident_id, tier, k, 0 g, station_id, role, km, brg, 'RESPONSE' act from lo left join nc using (incident_id) where k<=greatest(1,6-coalesce(c,0)) union all select incident_id, tier, k, 1, station_id, role, km, brg, case when role='REGION_HQ' then 'COORDINATION' else 'NOTIFICATION' end from cm where k<=2),
rcp as (select incident_id, tier, row_number() over (partition by incident_id order by g, k)-1 slot, station_id, role, km distance_km, brg bearing_deg, act as action from out)"""


def _ps(px: str, py: str, a: str, b: str) -> str:
    ax, ay, bx, by = f"{a}x", f"{a}y", f"{b}x", f"{b}y"
    t = f"greatest(0.0e0,least(1.0e0,coalesce((({px}-{ax})*({bx}-{ax})+({py}-{ay})*({by}-{ay}))/nullif(({bx}-{ax})*({bx}-{ax})+({by}-{ay})*({by}-{ay}),0),0.0e0)))"
    return f"sqrt(pow({px}-{ax}-{t}*({bx}-{ax}),2)+pow({py}-{ay}-{t}*({by}-{ay}),2))"


def _cr(o: str, a: str, b: str) -> str:
    return f"(({a}x-{o}x)*({b}y-{o}y)-({a}y-{o}y)*({b}x-{o}x))"


_X = f"(({_cr('p', 'q', 's')}>0)<>({_cr('p', 'q', 't')}>0) and ({_cr('s', 't', 'p')}>0)<>({_cr('s', 't', 'q')}>0))"
_COAST = """
mid as (select incident_id, hours_back, (min(x1)+max(x1))/2 mx, (min(y1)+max(y1))/2 my from {step_edges} group by incident_id, hours_back),
mm as (select m.incident_id, m.hours_back, (e.x1-mx)*KX px, (e.y1-my)*KY py, (e.x2-mx)*KX qx, (e.y2-my)*KY qy, (c.x1-mx)*KX sx, (c.y1-my)*KY sy, (c.x2-mx)*KX tx, (c.y2-my)*KY ty
  from mid m join {step_edges} e on e.incident_id=m.incident_id and e.hours_back=m.hours_back cross join {coast} c),
dd as (select incident_id, hours_back, min(case when """.replace("KX", p.lon_m("my")).replace("KY", p.lat_m("my")) + _X + " then 0.0e0 else least(" + ",".join(
    (_ps("px", "py", "s", "t"), _ps("qx", "qy", "s", "t"), _ps("sx", "sy", "p", "q"), _ps("tx", "ty", "p", "q"))) + ") end)/1000.0e0 km, bool_or(" + _X + ") hit from mm group by incident_id, hours_back)"

# detections and the planted outline (slick_id below 0) with their metrics, and the strips under the edges of all outlines
_PTS = "pts as (select slick_id, incident_id, k, x, y from {slick_points} union all select -1-incident_id, incident_id, k, x, y from {planted_points})," + _MET.replace("{slick_points}", "pts")
_AR = """
ori as (select {key}, incident_id, min(x1) ox, min(y1) oy from {edges} group by all),
ara as (select e.{key}, any_value(e.incident_id) incident_id, sum((x1-ox)*(y2-oy)-(x2-ox)*(y1-oy))/2 sarea from {edges} e join ori using ({key}, incident_id) group by e.{key}),
sw as (select e.{key}, e.incident_id, least(x1,x2) xl, greatest(x1,x2) xr, case when x1<=x2 then y1 else y2 end-f0 yl, (y2-y1)/(x2-x1) g, sign(x1-x2)*sign(sarea) s
  from {edges} e join ara using ({key}) join (select incident_id, min(y1) f0 from {edges} group by incident_id) q on q.incident_id=e.incident_id where x1<>x2)"""
_STRIPS = """
st as (select a.{key} a, b.{key} b, a.s*b.s s, greatest(a.xl,b.xl) l, least(a.xr,b.xr) r, a.yl ay, a.xl ax, a.g ag, b.yl byl, b.xl bx, b.g bg from sw a join sw b on a.incident_id=b.incident_id and {pair} and a.xl<b.xr and b.xl<a.xr),
sv as (select a, b, s, r-l w, ay+ag*(l-ax) al, ay+ag*(r-ax) ar, byl+bg*(l-bx) bl, byl+bg*(r-bx) br from st),
inter as (select a, b, greatest(0.0e0, sum(s*w*case when (al-bl)*(ar-br)>=0 then (least(al,bl)+least(ar,br))/2
  else (least(al,bl)+(al*br-ar*bl)/(al-ar-bl+br))/2*(al-bl)/(al-bl-ar+br)+((al*br-ar*bl)/(al-ar-bl+br)+least(ar,br))/2*(1-(al-bl)/(al-bl-ar+br)) end)) i from sv group by a, b)"""


def _strips(edges: str, key: str, pair: str) -> str:
    return (_AR + "," + _STRIPS).replace("{key}", key).replace("{edges}", edges).replace("{pair}", pair)


_K2 = lambda lat: p.lat_m(lat) + "*" + p.lon_m(lat) + "/1.0e6"
# area of a union by Green's theorem: what is left of each edge after the stretches inside other rings
_UNION = """
ed as (select incident_id i, hours_back h, k, x1, y1, x2, y2 from {step_edges}),
pr as (select a.i, a.h, a.k, b.h j, a.x2-a.x1 dx, a.y2-a.y1 dy, b.x2-b.x1 ex, b.y2-b.y1 ey, b.x1-a.x1 px, b.y1-a.y1 py,
  (b.y1>a.y1)<>(b.y2>a.y1) and a.x1<(b.x2-b.x1)*(a.y1-b.y1)/(b.y2-b.y1)+b.x1 ray from ed a join ed b on a.i=b.i and a.h<>b.h and (least(a.x1,a.x2)<=greatest(b.x1,b.x2))),
pt as (select i, h, k, j, ray, case when dx*ey-dy*ex<>0 then (px*ey-py*ex)/(dx*ey-dy*ex) end t, case when dx*ey-dy*ex<>0 then (px*dy-py*dx)/(dx*ey-dy*ex) end u from pr),
ps as (select i, h, k, j, count(*) filter (ray)%2 odd, coalesce(list(t order by t) filter (t>0 and t<1 and u>=0 and u<1), []) ts from pt group by i, h, k, j),
pb as (select i, h, k, j, ts, list_concat(case when odd=1 then [0.0e0] else []::double[] end, ts, case when (odd+len(ts))%2=1 then [1.0e0] else []::double[] end) b from ps),
iv as (select i, h, k, b[n] s, b[n+1] z from (select i, h, k, b, unnest(range(1, len(b), 2)) n from pb) q),
cv as (select i, h, k, sum(greatest(0.0e0, z-greatest(s, coalesce(w, 0.0e0)))) c from (select *, max(z) over (partition by i, h, k order by s, z rows between unbounded preceding and 1 preceding) w from iv) q group by i, h, k),
ce as (select i, min(x1) ox, min(y1) oy, (min(y1)+max(y1))/2 lat from ed group by i),
ua as (select ed.i, sum((1-coalesce(c,0.0e0))*((x1-ox)*(y2-oy)-(x2-ox)*(y1-oy)))/2 area, any_value(lat) lat, count(distinct ed.h) n_rings from ed join ce using (i) left join cv using (i, h, k) group by ed.i),
lk as (select i, count(distinct h) n from pb where j=h+1 and len(ts)>0 group by i)"""

_AFFECTED = """
bb as (select incident_id, hours_back, min(x1) x0, max(x1) x9, min(y1) y0, max(y1) y9 from {step_edges} group by all),
ps as (select b.incident_id, b.hours_back, c.seg_id, c.x1 sx, c.y1 sy, c.x2-c.x1 dx, c.y2-c.y1 dy, """ + p.dist_m("c.y1", "c.x1", "c.y2", "c.x2") + """/1000.0e0 km
  from bb b join {coast} c on least(c.x1,c.x2)<=x9 and greatest(c.x1,c.x2)>=x0 and least(c.y1,c.y2)<=y9 and greatest(c.y1,c.y2)>=y0),
tc as (select ps.*, ((e.x1-sx)*(e.y2-e.y1)-(e.y1-sy)*(e.x2-e.x1))/nullif(dx*(e.y2-e.y1)-dy*(e.x2-e.x1),0) t, ((e.x1-sx)*dy-(e.y1-sy)*dx)/nullif(dx*(e.y2-e.y1)-dy*(e.x2-e.x1),0) u from ps join {step_edges} e using (incident_id, hours_back)),
cu as (select incident_id, hours_back, seg_id, sx, sy, dx, dy, km, list_sort(list_concat([0.0e0,1.0e0], coalesce(list(t) filter (where t between 0 and 1 and u between 0 and 1), []))) cuts from tc group by all),
iv as (select * exclude (cuts), cuts[k] a, cuts[k+1] b from (select *, unnest(range(1, len(cuts))) k from cu) q),
mi as (select *, sx+dx*(a+b)/2 mx, sy+dy*(a+b)/2 my from iv where b>a),
ins as (select incident_id, hours_back, seg_id, a, b, km, count(*) filter (where (e.y1>my)<>(e.y2>my) and mx<(e.x2-e.x1)*(my-e.y1)/(e.y2-e.y1)+e.x1)%2 odd from mi join {step_edges} e using (incident_id, hours_back) group by incident_id, hours_back, seg_id, a, b, km),
af as (select incident_id, hours_back, sum((b-a)*km) km from ins where odd=1 group by incident_id, hours_back)"""

ORACLES: dict[str, str] = {
    "polygon_metrics": "with " + _MET + """ select ct.slick_id, round(area/1.0e6,6) area_km2, round(perim/1000.0e0,6) perimeter_km, round(lat,6) centroid_lat, round(lon,6) centroid_lon, round(greatest(w,h),3) major_axis_m, round(least(w,h),3) minor_axis_m,
 round(mod(90.0e0-degrees(case when w>=h then th else th+pi()/2 end)+720.0e0,180.0e0),4) major_axis_deg, round(sqrt(greatest(0,1-pow(least(w,h)/greatest(w,h),2))),6) eccentricity, round(perim/(2*sqrt(pi()*area)),6) shape_complexity
 from ct join ar using (slick_id) join rc on rc.slick_id=ct.slick_id and rc.r=1""",
    **dict.fromkeys(("polygon_iou", "polygon_iou_all"), "with " + _MET + """, ed as (select slick_id id, incident_id, x1, y1, x2, y2 from e union all select -(incident_id*100+hours_back), incident_id, x1, y1, x2, y2 from {step_edges}),""" + _strips("ed", "id", "a.id>=0 and b.id<0")
        + ", pr as (select a.incident_id, a.id slick_id, -b.id%100 hours_back, abs(a.sarea) aa, abs(b.sarea) ba, least(coalesce(i,0.0e0),abs(a.sarea),abs(b.sarea)) i, " + _K2("lat")
        + " k2 from ara a join ara b on a.incident_id=b.incident_id and a.id>=0 and b.id<0 join ct on ct.slick_id=a.id left join inter on inter.a=a.id and inter.b=b.id) select incident_id, slick_id, hours_back, round(i*k2,4) inter_km2, round((aa+ba-i)*k2,4) union_km2, round(i/(aa+ba-i),6) iou from pr"),
    "best_detection": "with " + _PTS + ", ed as (select slick_id id, incident_id, x1, y1, x2, y2 from e)," + _strips("ed", "id", "a.id<0 and b.id>=0") + """,
 pr as (select a.incident_id, b.id, coalesce(i,0.0e0)/(abs(a.sarea)+abs(b.sarea)-coalesce(i,0.0e0)) iou, abs(b.sarea) ba from ara a join ara b on a.incident_id=b.incident_id and a.id<0 and b.id>=0 left join inter on inter.a=a.id and inter.b=b.id),
 bd as (select *, row_number() over (partition by incident_id order by iou desc, ba desc, id) n, count(*) over (partition by incident_id) c from pr),
 mt as (select ct.slick_id, lon, lat, area/1.0e6 area, mod(90.0e0-degrees(case when w>=h then th else th+pi()/2 end)+720.0e0,180.0e0) ax from ct join ar using (slick_id) join rc on rc.slick_id=ct.slick_id and rc.r=1),
 oo as (select bd.incident_id, c n_detections, id slick_id, iou, t.area ta, m.area ma, t.ax tx, m.ax mx, (m.lon-t.lon)*""" + p.lon_m("((t.lat+m.lat)/2)") + " ox, (m.lat-t.lat)*" + p.lat_m("((t.lat+m.lat)/2)") + """ oy
   from bd join mt m on m.slick_id=bd.id join mt t on t.slick_id=-1-bd.incident_id where n=1)
 select incident_id, n_detections, slick_id, round(iou,5) iou, round(ta,5) planted_area_km2, round(ma,5) best_area_km2, round(tx,4) planted_axis_deg, round(mx,4) best_axis_deg, round(sqrt(ox*ox+oy*oy)/1000,5) centroid_offset_km, round(ma-ta,5) area_delta_km2,
  round(least(mod(abs(mx-tx),180.0e0),180.0e0-mod(abs(mx-tx),180.0e0)),4) axis_delta_deg from oo""",
    "origin_envelope": "with " + _UNION + " select ua.i incident_id, n_rings, n_rings-n n_parts, round(area*" + _K2("lat") + ",4) area_km2 from ua join lk using (i)",
    "scene_parts": "with " + _PTS + ", ed as (select slick_id id, incident_id, x1, y1, x2, y2 from e)," + _strips("ed", "id", "a.id<0 and b.id>=0") + """,
 pr as (select a.incident_id, abs(a.sarea) pa, abs(b.sarea) ba, coalesce(i,0.0e0) i from ara a join ara b on a.incident_id=b.incident_id and a.id<0 and b.id>=0 left join inter on inter.a=a.id and inter.b=b.id),
 la as (select incident_id, (min(y1)+max(y1))/2 lat from e group by incident_id),
 pp as (select incident_id, count(*)+1 n_rings, count(*)+1-count(*) filter (i>0) n_parts, greatest(any_value(pa)+coalesce(sum(ba-i) filter (i>0),0.0e0), coalesce(max(ba) filter (i=0),0.0e0)) area from pr group by incident_id)
 select incident_id, n_rings, n_parts, round(area*""" + _K2("lat") + ",4) area_km2 from pp join la using (incident_id)",
    "slick_off_land": "with " + _EDGE + "," + _LAND + ", ed as (select slick_id%3 t, incident_id, x1, y1, x2, y2 from e)," + _COVER
        + ", f as (select i.*, l.cx is not null ld from inn i left join land l on l.cx=i.cx and l.cy=i.cy), w as (select t, incident_id, count(*) filter (where not ld) wet from f group by all) select incident_id*3+t slick_id, count(*) cells from f join w using (t, incident_id) where not ld or wet=0 group by all",
    "on_land": "with " + _LAND + " select event_id, mmsi, l.cx is not null on_land from {ais} a left join land l on l.cx=cast(floor(lon/0.02e0) as bigint) and l.cy=cast(floor(lat/0.02e0) as bigint)",
    "land_share": "with " + _LAND + ", g as (select incident_id, unnest(range(cast(floor((cx-0.5e0)/0.02e0) as bigint), cast(floor((cx+0.5e0)/0.02e0) as bigint)+1)) gx, cy from {incidents}), h as (select incident_id, gx, unnest(range(cast(floor((cy-0.5e0)/0.02e0) as bigint), cast(floor((cy+0.5e0)/0.02e0) as bigint)+1)) gy from g) select incident_id, round(avg(case when l.cx is not null then 1.0e0 else 0.0e0 end),6) land_fraction from h left join land l on l.cx=gx and l.cy=gy group by incident_id",
    "coast_distance": "with " + _COAST + " select incident_id, hours_back, round(case when km<=800 then km end,5) distance_km, km<=800 and hit as intersects, km<=800 covered from dd",
    "coast_distance_all": "with " + _COAST + " select incident_id, hours_back, round(case when km<=800 then km end,5) distance_km, km<=800 and hit as intersects, km<=800 covered from dd",
    "affected_shore": "with " + _AFFECTED + " select incident_id, hours_back, round(coalesce(km,0.0e0),4) affected_km from bb left join af using (incident_id, hours_back)",
    "alert_messages": "with " + _ETA + f""", al as (select *, {_SEV} severity, {_REASONS} reasons, 8.0e0+(incident_id%130)/10.0e0 lat, 66.0e0+(incident_id%97)/8.0e0 lon, 1704067200000000+incident_id*60000000 acq_us from tr)
select incident_id, concat('ALERT-', incident_id, '-', strftime(make_timestamp(acq_us), '%Y%m%dT%H%MZ')) alert_id, severity,
 concat('PRIORITY ', severity, ' // SUSPECTED OPERATIONAL DISCHARGE', chr(10), 'POSITION ', printf('%02d°%05.2f''%s', cast(floor(abs(lat)) as bigint), (abs(lat)-floor(abs(lat)))*60, case when lat>=0 then 'N' else 'S' end), ' ',
  printf('%02d°%05.2f''%s', cast(floor(abs(lon)) as bigint), (abs(lon)-floor(abs(lon)))*60, case when lon>=0 then 'E' else 'W' end), chr(10), printf('AREA %.1f km2', area_km2), chr(10),
  case when shore_contact then printf('SHORELINE CONTACT FORECAST in %.0f h', eta_hours) else 'No shoreline contact within 72 h.' end, chr(10), reasons) message from al""",
    "shore_eta": "with " + _ETA + " select incident_id, round(area_km2,6) area_km2, closest_km, shore_contact, round(eta_hours,6) eta_hours from im",
    "tier": "with " + _ETA + f" select incident_id, cast(tier as bigint) tier, {_SEV} severity, {_REASONS} reasons from tr",
    "recipients": "with " + _RECIP + " select incident_id, cast(tier as bigint) tier, slot, station_id, role, distance_km, bearing_deg, action from rcp",
    "stations_marked": "with " + _RECIP + ", a as (select station_id, count(*) alerts, min(distance_km) nearest_km from rcp group by station_id) select s.station_id, s.role, s.region, alerts, nearest_km, alerts is not null addressed from {stations} s left join a on a.station_id=s.station_id",
    "incident_list": "with " + oa.HITS + "," + oa.BEST + ", g as (select incident_id, count(*) n, arg_min(mmsi,(-score,mmsi)) top from best group by incident_id) select i.incident_id, n is not null ready, area_km2, coalesce(n,0) suspects, top top_mmsi from {incidents} i left join g on g.incident_id=i.incident_id",
    "track_roles": "with " + oa.HITS + "," + oa.SCENE + "," + oa.BEST + """,
rk as (select incident_id, mmsi, row_number() over (partition by incident_id order by score desc, mmsi) as rank from best),
al as (select incident_id, mmsi, 1 p, null as rank from scene union all select incident_id, mmsi, 2, null from cands union all select incident_id, mmsi, 3, rank from rk),
bb as (select incident_id, mmsi, max(p) p, max(rank) as rank from al group by incident_id, mmsi)
select incident_id, mmsi, case p when 3 then 'suspect' when 2 then 'envelope' else 'filtered' end role, cast(rank as bigint) as rank, cast(case p when 3 then 2 when 2 then 1 else 0 end as bigint) draw_order from bb
union all select null, mmsi, 'outside', null, 0 from (select distinct mmsi from {ais}) v where mmsi not in (select mmsi from bb)""",
    "coast_window": "select seg_id, x1, y1, x2, y2 from {coast} where greatest(x1,x2)>=72.0e0 and least(x1,x2)<=73.0e0 and greatest(y1,y2)>=15.0e0 and least(y1,y2)<=18.0e0",
    "resolve_slick": "with d as (select incident_id, slick_id, case when slick_id%4=0 then 0.0e0 else (slick_id%7)/10.0e0 end conf from (select distinct slick_id, incident_id from {slick_points}) q where incident_id%5<>3), b as (select incident_id, slick_id from (select *, row_number() over (partition by incident_id order by conf desc, slick_id desc) k from d where conf>0) q where k=1), n as (select incident_id, count(*) c from d group by incident_id) select i.incident_id, b.slick_id, case when b.slick_id is not null then 'detected' else 'declared' end source, case when b.slick_id is not null then 'most confident detection' when c>0 then 'every detection has zero confidence' else 'no detections' end reason from {incidents} i left join b on b.incident_id=i.incident_id left join n on n.incident_id=i.incident_id",
    "contract_violations": "select event_id, concat_ws(',', case when lat not between -90 and 90 then 'lat_range' end, case when lon not between -180 and 180 then 'lon_range' end, case when sog<0 or sog>10 then 'sog_range' end, case when cog is null then 'cog_missing' end, case when flag not in ('IN','LR','MH','SG','PA') then 'flag_unknown' end) violations from {ais} where sog>10 or cog is null or flag not in ('IN','LR','MH','SG','PA')",
}
