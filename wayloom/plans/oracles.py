"""DuckDB SQL of the registered queries."""

from __future__ import annotations

VIEWS = """
positions_v as (select user_id as uid, event_id as pid, ts, epoch_us(ts) / 1.0e6 as t,
  1.240e1 + 1.0e-2*(user_id%10) + 2.0e-2*(event_id%5) + 1.0e-4*((event_id*31)%7) as lon,
  4.180e1 + 1.0e-2*(user_id%7) + 1.5e-2*(event_id%5) + 1.0e-4*((event_id*17)%5) as lat,
  case when event_type='error' then 1 else 3 end as gps_quality, event_id%5 as lid from events),
events_v as (select user_id as uid, event_id as eid, epoch_us(ts) / 1.0e6 as t,
  case event_type when 'click' then 'A' when 'view' then 'B' when 'purchase' then 'C' when 'error' then 'Q' else 'start' end as event_type,
  cast(floor(value) as int) as speed, cast(event_id%9 as int) as max_acc, cast(event_id%5 as int) as avg_acc,
  cast((event_id*13)%360 as int) as angle, cast(event_id%3 as varchar) as location_type, cast(event_id%60 as int) as duration from events),
crashes_v as (select user_id as uid, event_id as cid, epoch_us(ts) / 1.0e6 as t from events where event_type='signup' and value >= 100),
gaps as (select *, case when t - lag(t) over (partition by uid order by t, pid) > 43200 then 1 else 0 end as new_trip from positions_v where gps_quality >= 3),
points as (select *, cast(sum(new_trip) over (partition by uid order by t, pid rows unbounded preceding) as bigint) as tid from gaps),
lagged as (select *, lag(lon) over w as plon, lag(lat) over w as plat, lag(t) over w as pt, row_number() over w as k from points window w as (partition by uid, tid order by t, pid)),
steps0 as (select *, case when plon is not null then 2*6367.0*asin(sqrt(least(pow(sin(radians(lat-plat)/2),2)+cos(radians(plat))*cos(radians(lat))*pow(sin(radians(lon-plon)/2),2),1.0))) end as km, t - pt as dt from lagged),
allsteps as (select *, case when dt > 0 then km/(dt/3600) else 0.0 end as speed from steps0),
steps as (select * from allsteps where pt is not null),
trips as (select uid, tid, count(*) as n_points, min(t) as t0, max(t) as t1, coalesce(sum(km), 0.0) as length_km, max(t)-min(t) as duration_s,
  arg_min(lid, struct_pack(t := t, pid := pid)) as src, arg_max(lid, struct_pack(t := t, pid := pid)) as dst,
  arg_min(lon, struct_pack(t := t, pid := pid)) as lon0, arg_min(lat, struct_pack(t := t, pid := pid)) as lat0,
  arg_max(lon, struct_pack(t := t, pid := pid)) as lon1, arg_max(lat, struct_pack(t := t, pid := pid)) as lat1
  from allsteps group by uid, tid having count(*) > 1),
ends as (select uid, tid, src as lid, t0 as t, lon0 as lon, lat0 as lat from trips union all select uid, tid, dst, t1, lon1, lat1 from trips),
edges as (select uid, src, dst, count(*) as weight from trips group by all),
support as (select uid, lid, count(*) as support, row_number() over (partition by uid order by count(*) desc, lid) - 1 as rank from ends group by uid, lid),
stays0 as (select uid, src, lag(dst) over w as prev, lag(t1) over w as arrive, t0 as leave from trips window w as (partition by uid order by t0, tid)),
stays as (select uid, src as lid, arrive, leave, leave - arrive as stay_s from stays0 where prev = src),
orders_v as (select o_custkey as uid, o_orderkey as id, o_orderdate as ts, cast(year(o_orderdate)*12 + month(o_orderdate) - 1 as bigint) as month, o_orderstatus as status from orders),
periods_v as (select i as idx, 23940 + i as lo, 23944 + i as hi from range(10) r(i))"""

STEP = "180.0/16777216"
X = f"cast(greatest(least(floor((lon+180)/(2*{STEP})), 16777215), 0) as bigint)"
Y = f"cast(greatest(least(floor((90-lat)/({STEP})), 16777215), 0) as bigint)"
PATH = "concat(" + ", ".join(f"cast((({Y} >> {23 - k}) & 1)*2 + (({X} >> {23 - k}) & 1) as varchar)" for k in range(16)) + ")"
MONTH = "cast(year(make_timestamp(cast(floor(t) as bigint)*1000000))*12 + month(make_timestamp(cast(floor(t) as bigint)*1000000)) - 1 as int)"
TYPES, MEASURED, SUMS = ("A", "B", "C", "Q", "start", "stop"), ("A", "B", "C", "Q"), ("speed", "max_acc", "avg_acc")
COUNTERS = ["nbr_traj_start", "nbr_traj_stop", "nbr_traj_move", "traj_speed_sum", "traj_speed_count", *[f"nbr_evnt_{t}" for t in TYPES], *[f"{m}_{t}_sum" for t in MEASURED for m in SUMS], "nbr_crash"]


def _cells() -> str:
    row = lambda **v: ", ".join(f"{v.get(c, '0.0' if c == 'traj_speed_sum' else '0')} as {c}" for c in COUNTERS)
    own = MONTH.replace("(t)", "(t0)")
    moved = row(nbr_traj_start="(k=1)::int", nbr_traj_stop="(k=n_points and k>1)::int", nbr_traj_move="(k>1 and k<n_points)::int", traj_speed_sum="case when k>1 then speed else 0.0 end", traj_speed_count="(k>1)::int")
    happened = row(**{f"nbr_evnt_{t}": f"(event_type='{t}')::int" for t in TYPES}, **{f"{m}_{t}_sum": f"case when event_type='{t}' then {m} else 0 end" for t in MEASURED for m in SUMS})
    return f"""
active as (select distinct uid as auid, {own} as amonth from trips),
happened as (select e.*, lon, lat from events_v e join positions_v p on p.pid = e.eid),
parts as (
  select {own} as month_idx, {PATH} as path, {moved} from allsteps s join (select uid, tid, n_points, t0 from trips) using (uid, tid)
  union all select {MONTH}, {PATH}, {happened} from happened semi join active on auid = uid and amonth = {MONTH}
  union all select {MONTH}, {PATH}, {row(nbr_crash="1")} from (select * from positions_v where pid in (select cid from crashes_v)) semi join active on auid = uid and amonth = {MONTH}),
cells as (select month_idx, path, {", ".join(f"sum({c}) as {c}" for c in COUNTERS)} from parts group by month_idx, path)"""


def _counter_sums(digits: int = 6) -> str:
    return ", ".join(f"round(sum({c}), {digits}) as {c}" if c == "traj_speed_sum" else f"cast(sum({c}) as bigint) as {c}" for c in COUNTERS)


def _collective() -> str:
    """Means of cells' measures by user, over regular and other cells, cells of one tree node summed."""
    mean = {"avg_traj_speed": ("traj_speed_sum", "traj_speed_count")} | {f"avg_{m}_{t}": (f"{m}_{t}_sum", f"nbr_evnt_{t}") for t in MEASURED for m in SUMS}
    names = ["nbr_traj_start", "nbr_traj_stop", "nbr_traj_move", "avg_traj_speed", *[f"nbr_evnt_{t}" for t in TYPES], *[m for m in mean if m != "avg_traj_speed"], "nbr_crash"]
    each = ", ".join(f"coalesce({mean[m][0]} / nullif({mean[m][1]}, 0), 0.0) as {m}" if m in mean else f"{m}" for m in names)
    out = ", ".join(f"round(sum({m}*w) filter (where {'' if n == 'reg' else 'not '}r) / nullif(sum(w) filter (where {'' if n == 'reg' else 'not '}r), 0), 6) as {n}_{m}" for m in names for n in ("reg", "occ"))
    return f""", {_cells()},
c as (select path, {", ".join(f"sum({c}) as {c}" for c in COUNTERS)} from cells group by path),
pp as (select uid, tid, lid, {PATH} as path from points),
nodes as (select path[1:d] as node from pp, range(17) r(d) group by path[1:d] having count(*) >= 50 or path[1:d] = ''),
up as (select path, arg_max(node, length(node)) as ancestor from (select distinct path from pp) join nodes on starts_with(path, node) group by path),
v as (select uid, path, count(distinct tid) as w from pp group by uid, path),
reg as (select distinct pp.uid, pp.path from pp join support s on s.uid = pp.uid and s.lid = pp.lid where s.rank < 2),
j as (select v.uid, ancestor, reg.path is not null as r, sum(w) as w, {", ".join(f"sum({c}) as {c}" for c in COUNTERS)}
  from v join c using (path) join up using (path) left join reg on reg.uid = v.uid and reg.path = v.path group by all),
k as (select uid, r, w, {each} from j)
select uid, {out} from k group by uid"""


D_M = "2*6371000.0*asin(sqrt(least(pow(sin(radians({b}-{a})/2),2)*pow(cos(radians({d}-{c})/2),2)+pow(sin(radians({d}-{c})/2),2)*pow(cos(radians(({a}+{b})/2)),2),1.0)))"


def metres(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return D_M.format(a=lat1, b=lat2, c=lon1, d=lon2)


def _trip_features() -> str:
    parts = ("morning", "afternoon", "evening", "night")
    cols = ["round(tot_traj, 6) as tot_traj", "round(tot_km, 6) as tot_km", "round(tot_traveltime, 6) as tot_traveltime"]
    aggs = ["cast(count(*) as double) as tot_traj", "sum(length_km) as tot_km", "sum(duration_s) as tot_traveltime"]
    for n, c in (("km", "length_km"), ("traveltime", "duration_s"), ("speed", "speed")):
        aggs += [f"avg({c}) as avg_{n}", f"stddev_pop({c}) as std_{n}"]
        cols += [f"round(avg_{n}, 6) as avg_{n}", f"round(std_{n}, 6) as std_{n}"]
    for k, p in enumerate(parts):
        own = f"filter (where part = {k})"
        aggs += [f"cast(count(*) {own} as double) as {p}_traj", f"coalesce(sum(length_km) {own}, 0.0) as {p}_km", f"coalesce(sum(duration_s) {own}, 0.0) as {p}_ttime", f"coalesce(avg(speed) {own}, -1.0) as {p}_avg_speed", f"coalesce(stddev_pop(speed) {own}, -1.0) as {p}_std_speed"]
        cols += [f"round({p}_{m}, 6) as {p}_{m}" for m in ("traj", "km", "ttime", "avg_speed", "std_speed")]
        cols += [f"round(coalesce({p}_{m} / nullif({w}, 0), 0.0), 6) as {p}_n{m}" for m, w in (("traj", "tot_traj"), ("km", "tot_km"), ("ttime", "tot_traveltime"))]
    days = ("traj", "km", "traveltime", "max_speed", "min_speed")
    cols += [f"round({n}_{c}_per_day, 6) as {n}_{c}_per_day" for c in days for n in ("avg", "std")]
    per = ", ".join(f"avg({c}) as avg_{c}_per_day, stddev_pop({c}) as std_{c}_per_day" for c in days)
    hour = "(t0 - floor(t0/86400)*86400)/3600"
    return f"""
, f as (select *, floor(t0/86400) as day, length_km/nullif(duration_s/3600, 0) as speed,
   case when {hour} >= 6 and {hour} < 12 then 0 when {hour} >= 12 and {hour} < 18 then 1 when {hour} >= 18 and {hour} < 22 then 2 else 3 end as part from trips),
days as (select uid, day, count(*) as traj, sum(length_km) as km, sum(duration_s) as traveltime, max(speed) as max_speed, min(speed) as min_speed from f group by uid, day),
per as (select uid, {per} from days group by uid), main as (select uid, {", ".join(aggs)} from f group by uid)
select uid, {", ".join(cols)} from main join per using (uid)"""


def _event_features(by: str, name: str) -> str:
    ms = ", ".join(f"round(avg({c}), 6) as avg_{c}, round(stddev_pop({c}), 6) as std_{c}" for c in ("duration", "avg_acc", "max_acc", "angle"))
    rate = lambda c: f"(select uid, {by}, round(avg(n), 6) as avg_events_per_{name}_{c}, round(stddev_pop(n), 6) as std_events_per_{name}_{c} from (select uid, {by}, {c}, count(*) as n from e group by all) group by uid, {by})"
    return f"""
, e as (select *, floor(t/86400) as day, t - floor(t/86400)*86400 as tod from events_v),
m as (select uid, {by}, count(*) as tot_events, cast(sum(duration) as bigint) as tot_duration, {ms} from e group by uid, {by}),
w as (select *, round(tot_events / sum(tot_events) over (partition by uid), 6) as p_events, round(coalesce(tot_duration / nullif(sum(tot_duration) over (partition by uid), 0), 0.0), 6) as p_duration from m)
select * from w join {rate("day")} using (uid, {by}) join {rate("tod")} using (uid, {by})"""


def _cross() -> str:
    pairs = [(a, b) for a in ("Q", "B", "A", "C", "stop", "start") for b in "012"]
    n = lambda a, b: f"count(*) filter (where event_type='{a}' and location_type='{b}')"
    return "select uid, " + ", ".join([f"{n(a, b)} as tot_events_type_{a}_loc{b}" for a, b in pairs] + [f"round({n(a, b)} / count(*), 6) as ptot_events_type_{a}_loc{b}" for a, b in pairs]) + " from events_v group by uid"


KINDS, LOCATIONS = ("Q", "B", "A", "C", "stop", "start"), "012"
WAYS = [(i, j) for i in (1, 2, 3) for j in (1, 2, 3) if i != j]


def _event_wide() -> str:
    """One row of all events, one by type and one by location type for each event; a user's classes side by side."""
    classes = ["", *[f"_{t}" for t in KINDS], *[f"_loc{p}" for p in LOCATIONS]]
    measured = [f"{n}_{c}" for c in ("duration", "avg_acc", "max_acc", "angle") for n in ("avg", "std")]
    rates = [f"{n}_events_per_{c}" for c in ("day", "time") for n in ("avg", "std")]
    metrics = ["tot_events", "tot_duration", *measured, *rates]
    rate = lambda c: f"(select uid, cls, avg(n) as avg_events_per_{c}, stddev_pop(n) as std_events_per_{c} from (select uid, cls, {c}, count(*) as n from e group by all) group by uid, cls)"
    means = ", ".join(f"{'avg' if m[:3] == 'avg' else 'stddev_pop'}({m[4:]}) as {m}" for m in measured)
    wide = ", ".join(f"max({m}) filter (where cls = '{s}') as {m}{s}" for s in classes for m in metrics)
    value = lambda x, name, empty: f"round(coalesce(cast({x} as double), {empty}), 6) as {name}"
    cols = [value(f"{m}{s}", f"{m}{s}", "0.0" if m.startswith("tot") else "-1.0") for s in classes for m in metrics]
    cols += [value(f"{m}{s} / nullif({m}, 0)", f"{m}_p{s[1:]}", "0.0") for s in classes[1:] for m in ("tot_events", "tot_duration")]
    cols += [value(f"{n}_events_type_{t}_loc{p}", f"{n}_events_type_{t}_loc{p}", "0.0") for n in ("tot", "ptot") for t in KINDS for p in LOCATIONS]
    return f"""
, e as (select *, floor(t/86400) as day, t - floor(t/86400)*86400 as time, unnest(['', '_' || event_type, '_loc' || location_type]) as cls from events_v),
m as (select uid, cls, count(*) as tot_events, sum(duration) as tot_duration, {means} from e group by uid, cls),
j as (select * from m join {rate("day")} using (uid, cls) join {rate("time")} using (uid, cls)),
w as (select uid, {wide} from j group by uid), x as ({_cross()})
select uid, {", ".join(cols)} from (select distinct uid from trips) left join w using (uid) left join x using (uid)"""


def _imn_places() -> str:
    """Networks of each user's halves: sizes, the three most visited places, the ways between them, events there; and the change."""
    sums = [f"l{i}l{j}_count" for i, j in WAYS]
    at = [(f"l{i}_{t}", f"event_type = '{t}' and b = {i}") for t in KINDS for i in (1, 2, 3)] + [(f"l{i}l{j}_{t}", f"event_type = '{t}' and a = {i} and b = {j}") for t in KINDS for i, j in WAYS]
    counts = ", ".join(f"count(*) filter (where {c}) as {n}" for n, c in at)
    both = lambda i: f"(l{i}_indegree + l{i}_outdegree)"
    there = lambda i, x: f"case when nbr_locations >= {i} then {x} end"
    row = {n: n for n in ("nbr_locations", "nbr_movements", "radius_of_gyration", "entropy", "l1_count", "l2_count", "l3_count", *sums)}
    row |= {f"l{i}_{d}": there(i, f"l{i}_{d}") for i in (1, 2, 3) for d in ("indegree", "outdegree")}
    row |= {f"l{i}_dcentrality": there(i, f"case when nbr_locations = 1 then 1.0 else {both(i)} / (nbr_locations - 1) end") for i in (1, 2, 3)}
    row |= {"density": "coalesce(nbr_movements / nullif(nbr_locations * (nbr_locations - 1), 0), 0.0)", "avg_degree": "2 * u / nbr_locations", "avg_indegree": "nbr_movements / nbr_locations", "avg_outdegree": "nbr_movements / nbr_locations", "triangles": "3 * coalesce(tri, 0) / nbr_locations"}
    row |= {n: f"coalesce({n}, 0)" for n in [n for n, _ in at] + [f"mov_entropy_{t}" for t in KINDS]}
    entropy = "case when count(*) > 1 then -sum(p*log2(p))/log2(count(*)) else 0.0 end"
    gone = {f"{n}{s}": x for s in ("", "_mov") for n, x in (("jaccard", "1 - count(*) filter (where p > 0 and q > 0) / count(*) filter (where p > 0 or q > 0)"), ("cosine", "1 - sum(p*q) / sqrt(sum(p*p) * sum(q*q))"))}
    change = lambda name, src, keys, n, s: f"{name} as (select uid, count(*) filter (where q > 0) - count(*) filter (where p > 0) as delta_{n}, {gone['jaccard' + s]} as jaccard{s}, {gone['cosine' + s]} as cosine{s} from (select uid, {keys}, coalesce(sum(1.0::double) filter (where win = w0), 0) as p, coalesce(sum(1.0::double) filter (where win = w1), 0) as q from {src} join spans using (uid) group by uid, {keys}) group by uid)"
    names = [*row, *(f"{n}{s}" for s in ("", "_mov") for n in ("jaccard", "cosine")), "delta_locations", "delta_movements"]
    return f"""
, tw as (select *, cast(t0 >= 1705276800.0 as bigint) as win, uid * 2 + cast(t0 >= 1705276800.0 as bigint) as k from trips),
ew as (select uid, win, k, src as lid, lon0 as lon, lat0 as lat from tw union all select uid, win, k, dst, lon1, lat1 from tw),
sw as (select k, lid, count(*) as support, row_number() over (partition by k order by count(*) desc, lid) as rank from ew group by k, lid),
loc as (select k, count(*) as nbr_locations, {", ".join(f"max(support) filter (where rank = {i}) as l{i}_count" for i in (1, 2, 3))} from sw group by k),
gy as (select k, avg({metres('lon', 'lat', 'clon', 'clat')}) as radius_of_gyration from (select *, avg(lon) over (partition by k) as clon, avg(lat) over (partition by k) as clat from ew) group by k),
en as (select k, {entropy} as entropy from (select k, support / sum(support) over (partition by k) as p from sw) group by k),
dg as (select k, src, dst, count(*) as weight from tw group by all),
rk as (select dg.*, a.rank as a, b.rank as b from dg join sw a on a.k = dg.k and a.lid = dg.src join sw b on b.k = dg.k and b.lid = dg.dst),
ways as (select k, count(*) as nbr_movements, {", ".join(f"count(*) filter (where b = {i}) as l{i}_indegree, count(*) filter (where a = {i}) as l{i}_outdegree" for i in (1, 2, 3))}, {", ".join(f"coalesce(sum(weight) filter (where a = {i} and b = {j}), 0) as l{i}l{j}_count" for i, j in WAYS)} from rk group by k),
und as (select distinct k, least(src, dst) as x, greatest(src, dst) as y from dg), uc as (select k, count(*) as u from und group by k),
tri as (select p.k, count(*) as tri from und p join und q on p.k = q.k and p.y = q.x join und r on r.k = p.k and r.x = p.x and r.y = q.y where p.x < p.y and q.x < q.y group by p.k),
ev as (select r.k, event_type, dst, a.rank as a, b.rank as b from events_v e join tw r on e.uid = r.uid and e.t between r.t0 and r.t1 join sw a on a.k = r.k and a.lid = r.src join sw b on b.k = r.k and b.lid = r.dst),
hap as (select k, {counts} from ev group by k),
de as (select k, event_type, {entropy} as entropy from (select k, event_type, count(*) / sum(count(*)) over (partition by k, event_type) as p from ev group by k, event_type, dst) group by k, event_type),
spread as (select k, {", ".join(f"max(entropy) filter (where event_type = '{t}') as mov_entropy_{t}" for t in KINDS)} from de group by k),
each as (select k // 2 as uid, {", ".join(f"{x} as {n}" for n, x in row.items())} from loc join gy using (k) join en using (k) join ways using (k) join uc using (k) left join tri using (k) left join hap using (k) left join spread using (k)),
mean as (select uid, {", ".join(f"avg({n}) as {n}" for n in row)} from each group by uid),
spans as (select uid, min(win) as w0, max(win) as w1 from tw group by uid),
{change("cl", "ew", "lid", "locations", "")}, {change("cm", "tw", "src, dst", "movements", "_mov")}
select uid, {", ".join(f"round(coalesce(cast({n} as double), -1.0), 6) + 0.0 as {n}" for n in names)} from mean join cl using (uid) join cm using (uid)"""


def all_sql() -> dict[str, str]:
    u = "((1.245e1-plon)*(lon-plon)+(4.185e1-plat)*(lat-plat))/nullif(pow(lon-plon,2)+pow(lat-plat,2),0)"
    cu = f"least(greatest({u},0.0),1.0)"
    flat = "pow(lon-plon,2)+pow(lat-plat,2)=0"
    tu = "coalesce(least(greatest(600/nullif(t-pt,0),0.0),1.0),0.0)"
    b0 = "degrees(atan2(sin(radians(lon-plon))*cos(radians(lat)), cos(radians(plat))*sin(radians(lat))-sin(radians(plat))*cos(radians(lat))*cos(radians(lon-plon))))+360"
    stats4 = ", ".join(f"round(avg({c}), 6) as avg_{c}, round(stddev_pop({c}), 6) as std_{c}" for c in ("speed", "max_acc", "avg_acc", "duration"))
    hist = ", mins as (select uid, lid, unnest(range(cast(floor(arrive/60) as bigint), least(cast(floor(leave/60) as bigint), cast(floor(arrive/60) as bigint)+1439)+1)) as m from stays), hist as (select uid, lid, m%1440 as minute, count(*) as n from mins group by all)"
    half = ", old as (select uid, lid as oid, avg(lon) as olon, avg(lat) as olat from positions_v where t < 1705276800.0 group by uid, lid), new as (select uid, lid, avg(lon) as lon, avg(lat) as lat from positions_v where t >= 1705276800.0 group by uid, lid)"
    cells = f", {_cells()}"
    slots = lambda t: "case when {h}>21600 and {h}<=32400 then '06-09' when {h}>32400 and {h}<=64800 then '09-18' when {h}>64800 and {h}<=75600 then '18-21' else '21-06' end".format(h=f"({t} - floor({t}/86400)*86400)")
    days = lambda keys: f"select {keys}, (cast(floor(t/86400) as bigint)+3)%7 >= 5 as weekend, {slots('t')} as slot, count(distinct floor(t/86400)) as n_days from times group by all"
    steps_of = lambda a, b: f"unnest(range(0, cast(floor(({b}-{a})/3600) as bigint)+1))"
    fence = lambda src, keys, c, name: f"{name} as (select {keys}, {c} from {src} join (select {keys}, quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from {src} group by {keys}) using ({keys}) where {c} between q1-1.5*(q3-q1) and q3+1.5*(q3-q1))"
    q = {
        "trip_gap_sessions": "select uid, tid, n_points, round(length_km, 6) as length_km, round(duration_s, 6) as duration_s, src, dst from trips",
        "trip_features": _trip_features(),
        "distance_spherical": f"select pid, round({metres('plon', 'plat', 'lon', 'lat')}, 6) as d_m from steps",
        "distance_haversine": "select pid, round(km, 6) as d_km from steps",
        "bearing": f"select pid, round({b0} - 360*floor(({b0})/360), 6) as bearing from steps where plon <> lon or plat <> lat",
        "point_speed": "select pid, round(speed, 6) as speed from steps",
        "closest_point": f"select pid, round(case when {flat} then 1.245e1 else plon+{cu}*(lon-plon) end, 6) as lon, round(case when {flat} then 4.185e1 else plat+{cu}*(lat-plat) end, 6) as lat, round(case when {flat} then null else {cu} end, 6) as u from steps",
        "point_at_time": f"select pid, round(plon+{tu}*(lon-plon), 6) as lon, round(plat+{tu}*(lat-plat), 6) as lat from steps",
        "quadtree_path": f"select pid, {PATH} as path from positions_v",
        "geohash_cells": "select uid, count(distinct (floor((lon+180)/360*8192)*4096+floor((lat+90)/180*4096))) as k_min, count(distinct (floor((lon+180)/360*262144)*131072+floor((lat+90)/180*131072))) as k_max from positions_v group by uid",
        "cell_counters": f"{cells} select month_idx, path, {_counter_sums()} from cells group by month_idx, path",
        "cell_rollup": f"{cells} select path[1:12] as path, {_counter_sums()} from cells group by path[1:12]",
        "cell_period_rollup": f"{cells}, sp as (select i as idx, 24285 + i as lo, 24289 + i as hi from range(5) r(i)) select idx, path, {_counter_sums()} from cells join sp on month_idx >= lo and month_idx < hi group by idx, path",
        "event_interval_join": "select eid, e.uid, tid from events_v e join trips r on e.uid = r.uid and e.t between r.t0 and r.t1",
        "crash_interval_join": "select cid, e.uid, tid from crashes_v e join trips r on e.uid = r.uid and e.t between r.t0 and r.t1",
        "event_features_type": _event_features("event_type", "type"),
        "event_features_location": _event_features("location_type", "loc"),
        "event_features_cross": _cross(),
        "event_features_wide": _event_wide(),
        "imn_place_features": _imn_places(),
        "event_grouping_sets": "select uid, event_type, location_type, count(*) as n_events, cast(sum(duration) as bigint) as tot_duration from events_v group by grouping sets ((uid), (uid, event_type), (uid, location_type), (uid, event_type, location_type))",
        "movement_event_stats": f"select src, dst, event_type, count(*) as n, {stats4} from events_v e join trips r on e.uid = r.uid and e.t between r.t0 and r.t1 group by src, dst, event_type",
        "od_edges": "select uid, src, dst, weight from edges",
        "location_support_rank": "select uid, lid, support, rank from support",
        "next_location_entropy": ", p as (select uid, src, weight / sum(weight) over (partition by uid, src) as p from edges) select uid, src, round(case when count(*) > 1 then -sum(p*log2(p))/log2(count(*)) else 0.0 end, 6) as entropy from p group by uid, src",
        "radius_of_gyration": f", c as (select *, avg(lon) over (partition by uid) as clon, avg(lat) over (partition by uid) as clat from ends) select uid, round(avg({metres('lon', 'lat', 'clon', 'clat')}), 6) as gyration_m from c group by uid",
        "iqr_movement_stats": f", {fence('trips', 'uid, src, dst', 'length_km', 'fk')}, {fence('trips', 'uid, src, dst', 'duration_s', 'fs')} select * from (select uid, src, dst, count(*) as support from trips group by uid, src, dst) join (select uid, src, dst, round(quantile_cont(length_km, 0.5), 6) as median_km, round(avg(length_km), 6) as avg_km, round(stddev_pop(length_km), 6) as std_km from fk group by uid, src, dst) using (uid, src, dst) join (select uid, src, dst, round(quantile_cont(duration_s, 0.5), 6) as median_s, round(avg(duration_s), 6) as avg_s, round(stddev_pop(duration_s), 6) as std_s from fs group by uid, src, dst) using (uid, src, dst)",
        "user_movement_stats": f", top as (select uid, lid from support where rank < 2), between_ as (select t.* from trips t semi join top a on a.uid = t.uid and a.lid = t.src semi join top b on b.uid = t.uid and b.lid = t.dst), {fence('trips', 'uid', 'length_km', 'ak')}, {fence('trips', 'uid', 'duration_s', 'as_')}, {fence('between_', 'uid', 'length_km', 'rk')}, {fence('between_', 'uid', 'duration_s', 'rs')}, "
        + ", ".join(f"{v}2 as (select uid, avg({c}) as a, stddev_pop({c}) as s from {v} group by uid)" for v, c in (("ak", "length_km"), ("as_", "duration_s"), ("rk", "length_km"), ("rs", "duration_s")))
        + ", n as (select uid, count(*) as n_reg_traj, count(distinct (src, dst)) as n_reg_movs from between_ group by uid) select u.uid, round(ak2.a, 6) as avg_mov_length, round(ak2.s, 6) as std_mov_length, round(as_2.a, 6) as avg_mov_duration, round(as_2.s, 6) as std_mov_duration, round(rk2.a, 6) as avg_reg_mov_length, round(rk2.s, 6) as std_reg_mov_length, round(coalesce(rs2.a, as_2.a), 6) as avg_reg_mov_duration, round(coalesce(rs2.s, as_2.s), 6) as std_reg_mov_duration, coalesce(n_reg_traj, 0) as n_reg_traj, coalesce(n_reg_movs, 0) as n_reg_movs from (select distinct uid from trips) u left join ak2 using (uid) left join as_2 using (uid) left join rk2 using (uid) left join rs2 using (uid) left join n using (uid)",
        "travel_minute_hist": "select uid, dst, minute, count(*) as n from (select uid, dst, unnest(range(cast(floor((t0 - floor(t0/86400)*86400)/60) as bigint), cast(floor((t1 - floor(t1/86400)*86400)/60) as bigint)+1)) as minute from trips) group by uid, dst, minute",
        "movement_slot_days": f", times as (select uid, src, dst, t0 + 3600*k as t from (select *, {steps_of('t0', 't1')} as k from trips) union all select uid, src, dst, t1 from trips) {days('uid, src, dst')}",
        "first_seen_movements": "select uid, src, dst, row_number() over (partition by uid order by min(struct_pack(t0 := t0, tid := tid))) - 1 as mid, count(*) as n from trips group by uid, src, dst",
        "regular_gyration_entropy": f", e as (select ends.* from ends semi join (select uid, lid from support where rank < 2) top on top.uid = ends.uid and top.lid = ends.lid), c as (select *, avg(lon) over (partition by uid) as clon, avg(lat) over (partition by uid) as clat from e), p as (select uid, n / sum(n) over (partition by uid) as p from (select uid, lid, count(*) as n from e group by uid, lid)) select * from (select uid, round(avg({metres('lon', 'lat', 'clon', 'clat')}), 6) as gyration_m from c group by uid) join (select uid, round(case when count(*) > 1 then -sum(p*log2(p))/log2(count(*)) else 0.0 end, 6) as entropy from p group by uid) using (uid)",
        "support_share": "select uid, lid, support, round(support / max(support) over (partition by uid), 6) as share from support",
        "event_destination_entropy": ", x as (select e.uid, event_type, dst, count(*) as n from events_v e join trips r on e.uid = r.uid and e.t between r.t0 and r.t1 group by all), p as (select uid, event_type, n / sum(n) over (partition by uid, event_type) as p from x) select uid, event_type, round(case when count(*) > 1 then -sum(p*log2(p))/log2(count(*)) else 0.0 end, 6) as entropy from p group by uid, event_type",
        "top_place_events": ", top as (select uid, lid, rank from support where rank < 3) select e.uid, event_type, f.rank as from_rank, g.rank as to_rank, count(*) as n from events_v e join trips r on e.uid = r.uid and e.t between r.t0 and r.t1 join top g on g.uid = r.uid and g.lid = r.dst left join top f on f.uid = r.uid and f.lid = r.src group by all",
        "finite_speeds": "select pid, 'kept' as how, round(speed, 6) as x from steps where pid % 7 <> 0 and pid % 11 <> 0 union all select pid, 'cleaned', round(case when pid % 7 = 0 or pid % 11 = 0 then 0.0 else speed end, 6) from steps",
        "edge_change": "select uid, round(count(*) filter (where a > 0 and b > 0) / count(*), 6) as jaccard from (select uid, src, dst, count(*) filter (where t0 < 1705276800.0) as a, count(*) filter (where t0 >= 1705276800.0) as b from trips group by uid, src, dst) group by uid",
        "first_last_month": "select uid, min(month) as first, max(month) as last, arg_min(n, month) as n_first, arg_max(n, month) as n_last from (select uid, month, count(*) as n from orders_v group by uid, month) group by uid",
        "train_test_pairs": ", a as (select distinct uid, idx, hi from orders_v join periods_v on month >= lo and month < hi), l as (select uid, idx, case when exists (select 1 from orders_v o where o.uid = a.uid and o.month = a.hi and o.status = 'F') then 1 else 0 end as label from a) select x.uid, x.idx, x.label as train_label, y.label as test_label from l x join l y on y.uid = x.uid and y.idx = x.idx + 1",
        "near_months": "select uid, count(*) as n from orders_v where cast(ts as date) - interval 1 month >= date '1995-01-01' and cast(ts as date) + interval 1 month < date '1996-01-01' group by uid",
        "support_knee": ", c as (select *, row_number() over (partition by uid order by support, lid) - 1 as x, count(*) over (partition by uid) as n, min(support) over (partition by uid) as lo, max(support) over (partition by uid) as hi from support) select uid, arg_max(support, struct_pack(f := abs((hi-lo)*x - (n-1)*(support-lo)), x := -x)) as min_support from c group by uid",
        "stay_durations": "select uid, lid, count(*) as n, round(avg(stay_s), 6) as avg_s, round(stddev_pop(stay_s), 6) as std_s from stays group by uid, lid",
        "stay_minute_hist": f"{hist} select uid, lid, minute, n from hist",
        "stay_minute_share": f"{hist} select uid, lid, minute, round(n / sum(n) over (partition by uid, minute), 6) as share from hist",
        "timeslot_day_counts": f", waits as (select * from (select uid, lag(dst) over w as lid, lag(t1) over w as a, t0 as b from trips window w as (partition by uid order by t0, tid)) where lid is not null), times as (select uid, src as lid, t0 as t from trips union all select uid, dst, t1 from trips union all select uid, lid, a + 3600*k from (select *, {steps_of('a', 'b')} as k from waits where b >= a)) {days('uid, lid')}",
        "month_pair_windows": "select uid, m as first_month, count(*) as n from (select uid, unnest([month(ts)-1, month(ts)]) as m from orders_v) where m between 1 and 11 group by uid, m",
        "sliding_periods": "select idx, count(*) as n, count(distinct uid) as n_users from orders_v join periods_v on month >= lo and month < hi group by idx",
        "period_labels": ", a as (select distinct uid, idx, hi from orders_v join periods_v on month >= lo and month < hi) select uid, idx, case when exists (select 1 from orders_v o where o.uid = a.uid and o.month = a.hi and o.status = 'F') then 1 else 0 end as label from a",
        "anti_join_users": "select uid, count(*) as n from events_v where uid not in (select uid from crashes_v) group by uid",
        "first_event_per_month": "select uid, month, arg_min(id, struct_pack(ts := ts, id := id)) as id from orders_v group by uid, month",
        "dedup_first": "select uid, arg_min(id, struct_pack(ts := ts, id := id)) as id from orders_v group by uid",
        "nearest_center": f"{half} select pid, arg_min(oid, struct_pack(d := {metres('lon', 'lat', 'olon', 'olat')}, c := oid)) as cid from positions_v join old using (uid) group by pid",
        "cross_window_match": f"{half}, p as (select uid, lid, oid, {metres('lon', 'lat', 'olon', 'olat')} as d from new join old using (uid)), b as (select * from p qualify row_number() over (partition by uid, lid order by d, oid) = 1) select uid, lid, oid, round(d, 6) as d from b where d < 100 qualify row_number() over (partition by uid, oid order by d, lid) = 1",
        "jaccard_cosine_change": ", n as (select uid, lid, count(*) filter (where t < 1705276800.0) as a, count(*) filter (where t >= 1705276800.0) as b from ends group by uid, lid) select uid, round(count(*) filter (where a > 0 and b > 0) / count(*), 6) as jaccard, round(1 - sum(a*b) / nullif(sqrt(sum(a*a))*sqrt(sum(b*b)), 0), 6) as cosine from n group by uid",
        "graph_degree_density": ", nodes as (select uid, count(*) as n from (select uid, src from edges union select uid, dst from edges) group by uid), und as (select uid, count(distinct least(src, dst)*1000 + greatest(src, dst)) as u, count(*) as m from edges group by uid) select uid, n, m, round(coalesce(m / nullif(n*(n-1), 0), 0.0), 6) as density, round(2*u/n, 6) as avg_degree, round(m/n, 6) as avg_indegree from nodes join und using (uid)",
        "graph_triangles": ", un as (select distinct uid, least(src, dst) as a, greatest(src, dst) as b from edges where src <> dst) select x.uid, count(*) as triangles from un x join un y on x.uid = y.uid and x.b = y.a join un z on x.uid = z.uid and z.a = x.a and z.b = y.b group by x.uid",
        "collective_features": _collective(),
        "minmax_scale": "select c_custkey, round((c_acctbal - min(c_acctbal) over ()) / (max(c_acctbal) over () - min(c_acctbal) over ()), 6) as scaled from customer",
        "deviation_from_mean": "select c_custkey, round((c_acctbal - avg(c_acctbal) over ()) / (max(c_acctbal) over () - min(c_acctbal) over ()), 6) as deviation from customer",
        "quantile_bins": ", q as (select quantile_cont(c_acctbal, 0.25) as a, quantile_cont(c_acctbal, 0.5) as b, quantile_cont(c_acctbal, 0.75) as c from customer) select c_custkey, case when c_acctbal <= a then 0 when c_acctbal <= b then 1 when c_acctbal <= c then 2 else 3 end as bin from customer, q",
    }
    return {k: f"with {VIEWS}\n{v}" if v.lstrip().startswith(",") else f"with {VIEWS}\n{v}" for k, v in q.items()}
