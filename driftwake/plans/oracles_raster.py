"""Oracle SQL for pixel-table queries: brute-force neighbourhoods instead of windows."""

from __future__ import annotations

_DIM = "dim as (select scene_id, max(row_id) nr, max(col_id) nc from {pixels} group by scene_id)"
_DB = "px as (select scene_id, row_id, col_id, dn, case when dn>0 then dn/255.0e0*30.0e0-30.0e0 end db, case when dn>0 then pow(10.0e0,(dn/255.0e0*30.0e0-30.0e0)/10.0e0) else 0.0e0 end lin from {pixels})"
_CFAR = _DIM + "," + _DB + """,
h0 as (select p.scene_id, p.row_id, p.col_id, sum(q.lin) so, sum(q.lin*q.lin) qo, sum(case when abs(dc)<=4 then q.lin else 0.0e0 end) sg, sum(case when abs(dc)<=4 then q.lin*q.lin else 0.0e0 end) qg
  from px p join dim using (scene_id) cross join unnest(range(-12,13)) as b(dc) join px q on q.scene_id=p.scene_id and q.row_id=p.row_id and q.col_id=least(nc,greatest(0,p.col_id+dc)) group by p.scene_id, p.row_id, p.col_id),
nb as (select p.scene_id, p.row_id, p.col_id, any_value(p.lin) lin, sum(q.so) so, sum(q.qo) qo, sum(case when abs(dr)<=4 then q.sg else 0.0e0 end) sg, sum(case when abs(dr)<=4 then q.qg else 0.0e0 end) qg
  from px p join dim using (scene_id) cross join unnest(range(-12,13)) as a(dr) join h0 q on q.scene_id=p.scene_id and q.col_id=p.col_id and q.row_id=least(nr,greatest(0,p.row_id+dr)) group by p.scene_id, p.row_id, p.col_id),
cz as (select scene_id, row_id, col_id, (lin-(so-sg)/544.0e0)/sqrt(greatest((qo-qg)/544.0e0-pow((so-sg)/544.0e0,2),1e-12)) z from nb)"""


def _pass(src: str, out: str, k: int, axis: str, fn: str) -> str:
    """One axis of a square dilation (max) or erosion (all 2k+1 neighbours present and set)."""
    other = "row_id" if axis == "col_id" else "col_id"
    value = "max(q.m)" if fn == "grow" else f"case when sum(q.m)={2 * k + 1} then 1 else 0 end"
    return (f"{out} as (select p.scene_id, p.row_id, p.col_id, {value} m from {src} p cross join unnest(range(-{k},{k}+1)) as a(o) "
            f"join {src} q on q.scene_id=p.scene_id and q.{other}=p.{other} and q.{axis}=p.{axis}+o group by p.scene_id, p.row_id, p.col_id)")


_MORPH = "m0 as (select scene_id, row_id, col_id, case when dn between 1 and 40 or dn>150 then 1 else 0 end m from {pixels})," + ",".join(
    _pass(f"m{i}", f"m{i + 1}", 2, "row_id" if i % 2 else "col_id", fn)
    for i, fn in enumerate(("grow", "grow", "shrink", "shrink", "shrink", "shrink", "grow", "grow")))
_DIA = "(values (0,0),(0,1),(0,-1),(1,0),(-1,0),(0,2),(0,-2),(2,0),(-2,0),(1,1),(1,-1),(-1,1),(-1,-1)) o(dr,dc)"
_REACH = """
s as (select scene_id, row_id, col_id, row_id*16777216+col_id id from {pixels} where dn between 1 and 60 or dn>200),
reach as (select scene_id, id root, row_id, col_id from s union select r.scene_id, r.root, q.row_id, q.col_id from reach r join s q on q.scene_id=r.scene_id and abs(q.row_id-r.row_id)<=1 and abs(q.col_id-r.col_id)<=1)"""
# pixels that the darkness scorer puts at 0.5 or more, joined over their four sides, in place of the eight-sided mask
_HOT8 = _REACH
_HOT4 = _REACH.replace("dn between 1 and 60 or dn>200", "dn>0 and 1.0e0-2.0e0*(dn/255.0e0*30.0e0)/30.0e0>=0.5e0").replace(
    "abs(q.row_id-r.row_id)<=1 and abs(q.col_id-r.col_id)<=1", "abs(q.row_id-r.row_id)+abs(q.col_id-r.col_id)<=1")
_LAB = _REACH + ", lab as (select scene_id, row_id, col_id, min(root) label from reach group by scene_id, row_id, col_id)"
_MOM = _LAB + """,
mo as (select scene_id, label, count(*) area_px, avg(row_id) r, avg(col_id) c, coalesce(var_samp(row_id),0) vy, coalesce(var_samp(col_id),0) vx, coalesce(covar_samp(row_id,col_id),0) vxy from lab group by scene_id, label),
ml as (select *, (vx+vy)/2+sqrt(pow((vx-vy)/2,2)+vxy*vxy) l1, greatest((vx+vy)/2-sqrt(pow((vx-vy)/2,2)+vxy*vxy),0) l2, sqrt(pow((vx-vy)/2,2)+vxy*vxy) sp from mo)"""
_SC = "sc as (select scene_id, max(row_id)+1 ny, max(col_id)+1 nx from {pixels} group by scene_id)"
_TILES = _SC + """,
tl as (select scene_id, ys//24 ty, xs//24 tx, greatest(least(ys+32,ny)-32,0) y0, least(ys+32,ny) y1, greatest(least(xs+32,nx)-32,0) x0, least(xs+32,nx) x1 from (select *, unnest(range(0,greatest(nx-8,1),24)) xs from (select *, unnest(range(0,greatest(ny-8,1),24)) ys from sc) a) b)"""
_STITCH = _TILES + "," + _DB + """,
tp as (select px.scene_id, ty, tx, row_id, col_id, coalesce(db,-30.0e0) db from px join tl on tl.scene_id=px.scene_id and row_id>=y0 and row_id<y1 and col_id>=x0 and col_id<x1),
tm as (select scene_id, ty, tx, avg(db) m from tp group by all)"""
_ZONE = """
ze as (select scene_id, zone_id, k, 28.0e0+10.0e0*zone_id+(9.0e0+zone_id)*cos(radians(30.0e0*k)) x1, 44.0e0-14.0e0*zone_id+(6.0e0+zone_id)*sin(radians(30.0e0*k)) y1, 28.0e0+10.0e0*zone_id+(9.0e0+zone_id)*cos(radians(30.0e0*((k+1)%12))) x2, 44.0e0-14.0e0*zone_id+(6.0e0+zone_id)*sin(radians(30.0e0*((k+1)%12))) y2
  from (select distinct scene_id from {pixels}) s cross join unnest(range(0,2)) as z(zone_id) cross join unnest(range(0,12)) as e(k)),
zi as (select p.scene_id, zone_id, p.row_id, p.col_id, any_value(db) db from px p join ze on ze.scene_id=p.scene_id group by p.scene_id, zone_id, p.row_id, p.col_id having sum(case when (y1>p.row_id)<>(y2>p.row_id) and p.col_id<(x2-x1)*(p.row_id-y1)/(y2-y1)+x1 then 1 else 0 end)%2=1)"""

ORACLES: dict[str, str] = {
    "pixel_db": "with " + _DB + " select scene_id, row_id, col_id, round(db,6) db, round(lin,6) lin from px",
    "strided_sample": "select scene_id, row_id, col_id, dn from {pixels} where row_id%16=0 and col_id%16=0",
    "sigma0_calibration": "select scene_id, row_id, col_id, case when dn>0 then round(greatest(-40.0e0,case when dn*dn-9.0e0>0 then 10.0e0*log10(dn*dn-9.0e0)-45.0e0 end),6) end sigma0_db from {pixels}",
    "scene_percentiles": "with " + _DB + " select scene_id, round(quantile_cont(db,0.01),6) p01, round(quantile_cont(db,0.05),6) p05, round(quantile_cont(db,0.5),6) p50, round(quantile_cont(db,0.95),6) p95, round(quantile_cont(db,0.99),6) p99 from px where db is not null group by scene_id",
    "cfar_windows": "with " + _CFAR + " select scene_id, row_id, col_id, round(z,4) z, z>4.5e0 is_bright from cz",
    "cfar_summary": "with " + _CFAR + " select scene_id, count(*) pixels, count(*) filter (where z>4.5e0) detected_pixels, round(avg(case when z>4.5e0 then 1.0e0 else 0.0e0 end),9) false_alarm_rate from cz group by scene_id",
    "morphology": "with " + _MORPH + " select scene_id, row_id, col_id, cast(m as bigint) m from m8",
    "edge_gradient": "with " + _DB + "," + _DIM + """,
f as (select scene_id, row_id, col_id, coalesce(db,-30.0e0) f, case when dn between 1 and 60 then 1 else 0 end m from px),
gr as (select *, (coalesce(lead(f) over h,f)-coalesce(lag(f) over h,f))/nullif(coalesce(lead(col_id) over h,col_id)-coalesce(lag(col_id) over h,col_id),0) dh, (coalesce(lead(f) over v,f)-coalesce(lag(f) over v,f))/nullif(coalesce(lead(row_id) over v,row_id)-coalesce(lag(row_id) over v,row_id),0) dv from f window h as (partition by scene_id,row_id order by col_id), v as (partition by scene_id,col_id order by row_id)),
bd as (select p.scene_id, p.row_id, p.col_id, max(q.m) g, case when count(*)=13 then min(q.m) else 0 end s from f p cross join """ + _DIA + """ join f q on q.scene_id=p.scene_id and q.row_id=p.row_id+dr and q.col_id=p.col_id+dc group by p.scene_id, p.row_id, p.col_id)
select scene_id, round(avg(sqrt(dv*dv+dh*dh)),6) edge_gradient, count(*) band_px from bd join gr using (scene_id,row_id,col_id) where g=1 and s=0 group by scene_id""",
    "tile_grid": "with " + _TILES + " select scene_id, ty, tx, y0, y1, x0, x1 from tl",
    "stitch": "with " + _STITCH + " select tp.scene_id, row_id, col_id, round(avg(db-m),6) residual, count(*) tiles from tp join tm on tm.scene_id=tp.scene_id and tm.ty=tp.ty and tm.tx=tp.tx group by tp.scene_id, row_id, col_id",
    "zonal_stats": "with " + _DB + "," + _ZONE + " select scene_id, zone_id, count(db) pixels, round(avg(db),6) mean_value, round(median(db),6) median_value from zi group by scene_id, zone_id",
    "components": "with recursive " + _LAB + " select scene_id, row_id, col_id, label from lab",
    "tile_scoring": "with recursive " + _MOM.replace(_HOT8, _HOT4) + " select scene_id, label, area_px, round(r,6) \"row\", round(c,6) col, round(greatest(4*sqrt(l1),sqrt(area_px)),6) major_px, round(4*sqrt(l2),5) minor_px, round(case when sp>1e-12 then mod(degrees(atan2(vx-vy+2*sp,2*vxy))+180.0e0,180.0e0) else 0.0e0 end,5) bearing_deg from ml where area_px>=64",
    "component_shapes": "with recursive " + _MOM + " select scene_id, label, area_px, round(r,6) \"row\", round(c,6) col, round(greatest(4*sqrt(l1),sqrt(area_px)),6) major_px, round(4*sqrt(l2),5) minor_px, round(case when sp>1e-12 then mod(degrees(atan2(vx-vy+2*sp,2*vxy))+180.0e0,180.0e0) else 0.0e0 end,5) bearing_deg from ml where area_px>=5",
    "local_contrast": "with recursive " + _LAB + "," + _DB + """,
rg as (select l.scene_id, label, count(*) area_px, avg(db) mean_db, min(l.row_id)-24 r0, max(l.row_id)+24 r1, min(l.col_id)-24 c0, max(l.col_id)+24 c1 from lab l join px using (scene_id,row_id,col_id) group by l.scene_id, label),
fr as (select px.* from px left join lab using (scene_id,row_id,col_id) where lab.label is null),
bk as (select rg.scene_id, label, avg(db) ring from rg join fr on fr.scene_id=rg.scene_id and row_id between r0 and r1 and col_id between c0 and c1 group by rg.scene_id, label)
select rg.scene_id, rg.label, area_px, round(mean_db,6) mean_db, round(ring-mean_db,6) contrast_db from rg left join bk on bk.scene_id=rg.scene_id and bk.label=rg.label""",
}
