"""Shared SQL fragments of the oracle queries, written for DuckDB independently of the Spark operators."""

from __future__ import annotations

A = "6378137.0e0"
E2 = "0.00669437999014e0"
LAT_M = "({a}*(1.0e0-{e})*pi()/180.0e0/pow(1.0e0-{e}*sin(radians({p}))*sin(radians({p})),1.5e0))"
LON_M = "({a}*pi()/180.0e0*cos(radians({p}))/sqrt(1.0e0-{e}*sin(radians({p}))*sin(radians({p}))))"


def lat_m(p: str) -> str:
    return LAT_M.format(a=A, e=E2, p=p)


def lon_m(p: str) -> str:
    return LON_M.format(a=A, e=E2, p=p)


def dist_m(y1: str, x1: str, y2: str, x2: str) -> str:
    mid = f"(({y1}+{y2})/2.0e0)"
    dx, dy = f"(({x2}-{x1})*{lon_m(mid)})", f"(({y2}-{y1})*{lat_m(mid)})"
    return f"sqrt({dx}*{dx}+{dy}*{dy})"


def haversine(y1: str, x1: str, y2: str, x2: str) -> str:
    return (f"2.0e0*6371.0088e0*asin(least(1.0e0,sqrt(pow(sin(radians({y2}-{y1})/2),2)+cos(radians({y1}))*"
            f"cos(radians({y2}))*pow(sin(radians({x2}-{x1})/2),2))))")


def bearing(y1: str, x1: str, y2: str, x2: str) -> str:
    y = f"sin(radians({x2}-{x1}))*cos(radians({y2}))"
    x = f"cos(radians({y1}))*sin(radians({y2}))-sin(radians({y1}))*cos(radians({y2}))*cos(radians({x2}-{x1}))"
    return f"mod(degrees(atan2({y},{x}))+360.0e0,360.0e0)"


def values(table: dict, *cols: str) -> str:
    rows = ",".join("(" + ",".join(f"'{v}'" if isinstance(v, str) else str(v) for v in kv) + ")" for kv in table.items())
    return f"(values {rows}) as t({','.join(cols)})"


# consecutive fixes of each vessel, and the checks made on every segment
SEG0 = """
s0 as (select *, lag(t_us) over w pt, lag(lat) over w plat, lag(lon) over w plon, lag(sog) over w psog from {ais} window w as (partition by mmsi order by t_us)),
s1 as (select *, (t_us-pt)/1.0e6 dt_s, """ + dist_m("plat", "plon", "lat", "lon") + """ dist_m from s0),
s2 as (select *, case when pt is null then null when dt_s>0 then dist_m/dt_s/0.514444e0 else 0.0e0 end kn from s1),
seg as (select *, lag(kn) over (partition by mmsi order by t_us) kn0, (psog+sog)/2.0e0 rep from s2)"""
CHECKS = SEG0 + """,
chk as (select *, abs(kn-rep) off, abs(kn-kn0)*0.514444e0/greatest(dt_s,1.0e0) acc,
  coalesce(abs(kn-rep)>5.0e0 and abs(sog-psog)<=3.0e0,false) is_dis, coalesce(kn>60.0e0,false) is_tel,
  coalesce(abs(kn-kn0)*0.514444e0/greatest(dt_s,1.0e0)>1.0e0,false) is_acc, coalesce(dt_s>900.0e0,false) is_gap from seg)"""
FIRST = """
first_fix as (select * from (select *, row_number() over (partition by mmsi order by t_us, event_id) rn from {ais}) q where rn=1)"""
NORMS = """
norms as (select mmsi, count(*) n_fixes, avg(case when sog>3 then 1.0e0 else 0.0e0 end) uf, median(sog) med,
  mod(degrees(atan2(avg(sin(radians(cog))),avg(cos(radians(cog)))))+720.0e0,360.0e0) prev_deg, count(*) filter (where cog<>0) n_course,
  min(t_us) filter (where sog>3) m0, max(t_us) filter (where sog>3) m1 from {ais} group by mmsi)"""


def runs_sql(source: str, flag: str, extra: str, name: str = "rn") -> str:
    """CTEs giving one row per contiguous true stretch: run_start, run_end (first false row or last row)."""
    return f"""
{name}a as (select *, coalesce({flag},false) f, lead(t_us) over (partition by mmsi order by t_us) nx from {source}),
{name}b as (select *, sum(case when f then 0 else 1 end) over (partition by mmsi order by t_us rows unbounded preceding) g from {name}a),
{name} as (select mmsi, min(t_us) run_start, max(coalesce(nx,t_us)) run_end, max(t_us) last_true, count(*) n_rows, {extra} from {name}b where f group by mmsi, g)"""


SLOW = "sr_src as (select a.mmsi, a.t_us, a.sog, n.med from {ais} a join norms n on a.mmsi=n.mmsi where n_fixes>=12 and uf>=0.05e0 and med>6)," + runs_sql(
    "sr_src", "sog<med*0.45e0", "avg(sog) mean_sog, max(med) med", "sr") + """,
slow as (select * from (select *, (run_end-run_start)/3.6e9 as hours, row_number() over (partition by mmsi order by run_start) k from sr where (run_end-run_start)/3.6e9>=1.0e0) q where k=1)"""
COURSE = "cd_src as (select a.mmsi, a.t_us, abs(mod(a.cog-n.prev_deg+540.0e0,360.0e0)-180.0e0) dev from {ais} a join norms n on a.mmsi=n.mmsi where n_fixes>=12 and uf>=0.05e0 and n_fixes>20 and n_course>0)," + runs_sql(
    "cd_src", "dev>60.0e0", "avg(dev) mean_dev", "cd") + """,
course as (select * from (select *, (run_end-run_start)/3.6e9 as hours, row_number() over (partition by mmsi order by run_start) k from cd where (run_end-run_start)/3.6e9>=0.75e0) q where k=1)"""
HOPS = """
fx as (select mmsi, t_us, lat, lon, sog from {ais}),
hop as (select a.mmsi, a.t_us, b.t_us nt from fx a asof left join fx b on a.mmsi=b.mmsi and a.t_us+3600000000<=b.t_us),
chain as (select mmsi, min(t_us) t_us from fx group by mmsi union all select h.mmsi, h.nt from chain c join hop h on h.mmsi=c.mmsi and h.t_us=c.t_us where h.nt is not null)"""
LOITER = HOPS + """,
lw as (select c.mmsi, c.t_us, h.nt, a.lat, a.lon, b.lat lat2, b.lon lon2 from chain c join hop h on h.mmsi=c.mmsi and h.t_us=c.t_us and h.nt is not null
  join fx a on a.mmsi=c.mmsi and a.t_us=c.t_us join fx b on b.mmsi=c.mmsi and b.t_us=h.nt),
lm as (select lw.mmsi, lw.t_us, lw.nt, any_value(lw.lat) lat, any_value(lw.lon) lon, any_value(""" + dist_m("lw.lat", "lw.lon", "lat2", "lon2") + """)/1000.0e0 net_km, avg(f.sog) mean_sog
  from lw join fx f on f.mmsi=lw.mmsi and f.t_us>=lw.t_us and f.t_us<lw.nt group by lw.mmsi, lw.t_us, lw.nt),
loit as (select * from (select lm.*, row_number() over (partition by lm.mmsi order by nt-lm.t_us desc, lm.t_us) k from lm join norms n on n.mmsi=lm.mmsi
  where n_fixes>=12 and uf>=0.05e0 and mean_sog<2.0e0 and net_km<3.0e0 and m0<lm.t_us and m1>=nt) q where k=1)"""
