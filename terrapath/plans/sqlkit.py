"""ANSI/DuckDB building blocks of the oracle queries (independent restatement)."""

from __future__ import annotations

from terrapath import config as C

PI2 = "6.283185307179586::double"


def hav(la1: str, lo1: str, la2: str, lo2: str) -> str:
    a = (
        f"(pow(sin(radians(({la2})-({la1}))/2),2)+cos(radians({la1}))*cos(radians({la2}))"
        f"*pow(sin(radians(({lo2})-({lo1}))/2),2))"
    )
    return f"(12742000.0::double*atan2(sqrt({a}),sqrt(1-{a})))"


def pmod(x: str, n: str = "360.0::double") -> str:
    return f"((({x})%{n})+{n})%{n}"


def brg(lo1: str, la1: str, lo2: str, la2: str) -> str:
    y = f"sin(radians(({lo2})-({lo1})))*cos(radians({la2}))"
    x = (
        f"cos(radians({la1}))*sin(radians({la2}))-sin(radians({la1}))*cos(radians({la2}))"
        f"*cos(radians(({lo2})-({lo1})))"
    )
    return "(" + pmod(f"degrees(atan2({y},{x}))+360.0::double") + ")"


def dest_lat(lon: str, lat: str, b: str, d: str) -> str:
    a = f"(({d})/6371000.0::double)"
    return f"degrees(asin(sin(radians({lat}))*cos({a})+cos(radians({lat}))*sin({a})*cos(radians({b}))))"


def dest_lon(lon: str, lat: str, b: str, d: str) -> str:
    a = f"(({d})/6371000.0::double)"
    s2 = f"sin(asin(sin(radians({lat}))*cos({a})+cos(radians({lat}))*sin({a})*cos(radians({b}))))"
    return (
        f"degrees(radians({lon})+atan2(sin(radians({b}))*sin({a})*cos(radians({lat})),"
        f"cos({a})-sin(radians({lat}))*{s2}))"
    )


def cls(s: str) -> str:
    return (
        f"(CASE WHEN isnan({s}) THEN 'green' WHEN ({s})>=40 THEN 'black' WHEN ({s})>=25 THEN 'red' "
        f"WHEN ({s})>=15 THEN 'blue' ELSE 'green' END)"
    )


def compass(b: str) -> str:
    words = ",".join(f"'{c}'" for c in C.COMPASS)
    return f"([{words}])[cast(floor({pmod(f'({b})+22.5::double')}/45.0) as int)+1]"


def case_map(table: dict, key: str) -> str:
    def q(v):
        return str(v) if isinstance(v, (int, float)) else ("'" + str(v).replace("'", "''") + "'")

    return "(CASE " + key + " " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + " END)"


def words(ws: list[str]) -> str:
    return "([" + ",".join("'" + w.replace("'", "''") + "'" for w in ws) + "])"


def pick(ws: str, n: str) -> str:
    return f"{ws}[cast(({n}) % len({ws}) as int)+1]"


N_ROWS = "(SELECT max(vec_id)+1 FROM embeddings)"
SOUTH = f"(47.0::double-{N_ROWS}*0.00054::double)"
EAST = "(10.0::double+64*0.0008::double)"


def row_of(lat: str) -> str:
    return f"cast(trunc((47.0::double-({lat})*1.0::double)/0.00054::double) as bigint)"


def col_of(lon: str) -> str:
    return f"cast(trunc((({lon})*1.0::double-10.0::double)/0.0008::double) as bigint)"


def inside(lon: str, lat: str) -> str:
    return f"(({lon}) BETWEEN 10.0::double AND {EAST} AND ({lat}) BETWEEN {SOUTH} AND 47.0::double)"


RESORT = "CASE WHEN {p}%3=0 THEN 0 ELSE 1+({p}//8) END"

CTE: dict[str, str] = {}
DEPS: dict[str, list[str]] = {}


def cte(name: str, sql: str, *deps: str) -> None:
    CTE[name] = sql
    DEPS[name] = list(deps)


cte(
    "dem_raw",
    """SELECT row, col, CASE WHEN (row*64+col)%997=0 THEN -9999.0::double ELSE
      2000.0::double+45.0::double*abs(row%100-50)+15.0::double*col+20.0::double*v END AS elevation
      FROM (SELECT vec_id AS row, i-1 AS col, embedding[i]::double AS v
            FROM (SELECT vec_id, embedding, unnest(range(1,len(embedding)+1)) AS i FROM embeddings))""",
)
cte("dem", "SELECT row, col, CASE WHEN elevation<>-9999.0 THEN elevation END AS elevation FROM dem_raw", "dem_raw")
cte(
    "req",
    """SELECT c_custkey AS request_id, 10.002::double+0.00003::double*((7*c_custkey)%1700) AS lon,
      46.99::double-0.00011::double*((13*c_custkey)%2200) AS lat, 105.0::double+50.0::double*(c_custkey%19) AS length_m
      FROM customer""",
)
cte(
    "tgt",
    """SELECT request_id, lon, lat, lon+0.0004::double*(request_id%5-2) AS target_lon,
      lat-0.00031::double*(1+request_id%8+CASE WHEN request_id%50=0 THEN 26 ELSE 0 END) AS target_lat FROM req""",
    "req",
)
cte(
    "tracks",
    f"""SELECT {RESORT.format(p="p")} AS resort_id, p AS path_id, s AS seq,
      10.02::double+0.0003::double*(p%11)+0.00002::double*(s%3) AS lon,
      46.95::double-0.00035::double*s-0.0002::double*(p%5) AS lat,
      2600.0::double+20.0::double*(p%5)-1.5::double*(1+p%13)*s+4.0::double*abs(s%12-6)+least(value,100.0::double)/50.0::double AS elevation
      FROM (SELECT event_id//64 AS p, event_id%64 AS s, value FROM events)""",
)
cte(
    "seg_pts",
    """SELECT resort_id, path_id, seg_no, seq, lon, lat, elevation, path_id*8+seg_no+1 AS n FROM (
      SELECT *, seq//10 AS seg_no FROM tracks UNION ALL SELECT *, seq//10-1 FROM tracks WHERE seq%10=0 AND seq>0)
      QUALIFY count(*) OVER (PARTITION BY path_id, seg_no)>=2""",
    "tracks",
)
cte(
    "seg_step",
    f"""SELECT *, coalesce({hav("plat", "plon", "lat", "lon")},0.0) AS d,
      sum(coalesce({hav("plat", "plon", "lat", "lon")},0.0)) OVER (PARTITION BY n ORDER BY seq) AS cum FROM (
      SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM seg_pts WINDOW w AS (PARTITION BY n ORDER BY seq))""",
    "seg_pts",
)
cte(
    "seg_sum",
    """SELECT n, max(resort_id) AS resort_id, max(path_id) AS path_id, max(seg_no) AS seg_no, count(*) AS n_pts,
      max(cum) AS length_m, arg_min(elevation,seq)-arg_max(elevation,seq) AS drop_m,
      arg_min(elevation,seq) AS start_elev, arg_max(elevation,seq) AS end_elev,
      arg_min(lon,seq) AS start_lon, arg_max(lon,seq) AS end_lon, arg_min(lat,seq) AS start_lat, arg_max(lat,seq) AS end_lat
      FROM seg_step GROUP BY n""",
    "seg_step",
)
cte(
    "seg_win",
    """SELECT a.n, max(CASE WHEN b.cum>a.cum THEN abs((a.elevation-b.elevation)/(b.cum-a.cum))*100 END) AS best
      FROM seg_step a JOIN seg_step b ON a.n=b.n AND b.seq>a.seq JOIN seg_sum t ON t.n=a.n
      WHERE b.cum<=a.cum+300 AND t.length_m>a.cum+300 AND
        NOT EXISTS (SELECT 1 FROM seg_step c WHERE c.n=a.n AND c.seq>b.seq AND c.cum<=a.cum+300) GROUP BY a.n""",
    "seg_step",
    "seg_sum",
)
cte(
    "seg",
    f"""SELECT *, 'S'||n AS segment_id, 'N'||n AS start_node_id, 'N'||(n+1) AS end_node_id, 'Segment '||n AS name,
      {cls("max_slope_pct")} AS difficulty,
      CASE WHEN abs(side)<2 THEN 'flat' WHEN side>0 THEN 'right' ELSE 'left' END AS side_dir FROM (
      SELECT s.*, CASE WHEN length_m>0 THEN drop_m/length_m*100 ELSE 0.0 END AS avg_slope_pct,
        CASE WHEN length_m>=300 THEN greatest(CASE WHEN length_m>0 THEN drop_m/length_m*100 ELSE 0.0 END,
             coalesce(w.best, -1e300)) ELSE CASE WHEN length_m>0 THEN drop_m/length_m*100 ELSE 0.0 END END AS max_slope_pct,
        ((path_id*7+seg_no*5)%61-30)::double AS side
      FROM seg_sum s LEFT JOIN seg_win w ON s.n=w.n)""",
    "seg_sum",
    "seg_win",
)
cte(
    "slope",
    f"""SELECT {RESORT.format(p="p")} AS resort_id, p AS path_id, 'SL'||(p+1) AS slope_id, 'Slope '||(p+1) AS name,
      list_transform(range(0,ns+1), lambda i: 'S'||(p*8+i+1)) || CASE WHEN p%7=0 THEN ['S99000000000'||p] ELSE []::varchar[] END AS segment_ids,
      'N'||(p*8+1) AS start_node_id, 'N'||(p*8+ns+2) AS end_node_id FROM (
      SELECT event_id//64 AS p, (max(event_id%64)-1)//10 AS ns FROM events GROUP BY 1 HAVING max(event_id%64)>=1 AND (event_id//64)%4<>0)""",
)
cte(
    "slope_seg",
    """SELECT resort_id, slope_id, path_id, i AS pos, segment_ids[i+1] AS segment_id FROM (
      SELECT *, unnest(range(0,len(segment_ids))) AS i FROM slope)""",
    "slope",
)
cte(
    "pnode",
    """SELECT resort_id, 'N'||o AS node_id, o AS node_ord, lon, lat, elevation FROM (
      SELECT *, path_id*8+CASE WHEN seq=63 THEN 7 ELSE seq//10 END+1 AS o FROM tracks WHERE seq%10=0 OR seq=63)""",
    "tracks",
)
cte(
    "lift",
    f"""SELECT e.* , coalesce(a.elevation,2000.0) AS start_elevation, coalesce(b.elevation,2000.0) AS end_elevation FROM (
      SELECT *, start_lon+0.0004::double*(lift_no%7-3) AS end_lon, start_lat+0.000103717::double+0.00120313::double*(lift_no%13) AS end_lat FROM (
      SELECT {RESORT.format(p="c_custkey")} AS resort_id, c_custkey AS lift_no, 'L'||(c_custkey+1) AS lift_id,
        (['surface_lift','chairlift','gondola','aerial_tram'])[c_custkey%4+1] AS lift_type,
        'N'||(100000000+2*c_custkey) AS start_node_id, 'N'||(100000000+2*c_custkey+1) AS end_node_id,
        10.002::double+0.00003::double*((7*c_custkey)%1700) AS start_lon,
        46.99::double-0.00011::double*((13*c_custkey)%2200) AS start_lat FROM customer)) e
      LEFT JOIN dem a ON a.row={row_of("e.start_lat")} AND a.col={col_of("e.start_lon")}
      LEFT JOIN dem b ON b.row={row_of("e.end_lat")} AND b.col={col_of("e.end_lon")}""",
    "dem",
)
cte(
    "lnode",
    """SELECT resort_id, start_node_id AS node_id, 100000000+2*lift_no AS node_ord, start_lon AS lon, start_lat AS lat, start_elevation AS elevation FROM lift
      UNION ALL SELECT resort_id, end_node_id, 100000000+2*lift_no+1, end_lon, end_lat, end_elevation FROM lift""",
    "lift",
)
cte("node", "SELECT * FROM pnode UNION ALL SELECT * FROM lnode", "pnode", "lnode")
cte(
    "station",
    """SELECT s_suppkey AS node_ord, 'N'||(s_suppkey+1) AS node_id, 10.01::double+0.0003::double*(s_suppkey%10) AS lon,
      46.90::double+0.0002::double*(s_suppkey//10) AS lat, 1500.0::double+s_acctbal/20.0 AS elevation FROM supplier""",
)
cte(
    "tap",
    """SELECT c_custkey AS tap_id, 10.0099053::double+0.0003::double*(c_custkey%12)+0.00001::double*(c_custkey%37) AS lon,
      46.8995037::double+0.0002::double*(c_custkey%17)+0.00001::double*(c_custkey%29) AS lat FROM customer""",
)
cte(
    "edits",
    """SELECT user_id AS resort_id, event_id AS op_seq, 'E'||event_id AS entity_id,
      CASE event_type WHEN 'view' THEN 'ADD_SEGMENTS' WHEN 'purchase' THEN 'FINISH_SLOPE' WHEN 'signup' THEN 'ADD_LIFT'
        WHEN 'click' THEN 'DELETE_SLOPE' ELSE 'UNDO' END AS op FROM events""",
)


def with_(*names: str, recursive: bool = False, **extra: str) -> str:
    """WITH clause holding the named fixtures (and their inputs) plus extra CTEs in order."""
    seen: list[str] = []

    def add(n: str) -> None:
        for d in DEPS[n]:
            add(d)
        if n not in seen:
            seen.append(n)

    for n in names:
        add(n)
    # shared inputs are computed once
    keep = lambda n: "AS MATERIALIZED" if n in ("dem", "gz", "ge", "gs", "seg", "lift") else "AS"
    parts = [f"{n} {keep(n)} ({CTE[n]})" for n in seen] + [f"{n} {keep(n)} ({s})" for n, s in extra.items()]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"
