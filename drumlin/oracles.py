"""Builders of DuckDB's SQL for results that need recursion: orderings, steep areas, trees of
ranges, spanning trees and hierarchies. Each states the rules in SQL's own terms (windows,
keyed recursions, subqueries) over a table (point_id, a, w) of one axis."""

from __future__ import annotations


def plain(name: str, source: str) -> str:
    """A cloud whose points weigh 1."""
    return f"{name} AS MATERIALIZED (SELECT point_id, a, 1::BIGINT AS w, row_number() OVER (ORDER BY a, point_id) AS pos FROM {source})"


def distinct(name: str, source: str, axes: tuple[str, ...] = ("a",)) -> str:
    """A cloud of distinct points in order of first sight, and which one each row is."""
    keys = ", ".join(axes)
    return f"""{name} AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {keys}) AS pos FROM (SELECT (row_number() OVER (ORDER BY min(point_id)) - 1)::BIGINT AS point_id, {keys}, count(*)::BIGINT AS w FROM {source} GROUP BY {keys})),
{name}_of AS MATERIALIZED (SELECT s.point_id AS row_id, u.point_id FROM {source} s JOIN {name} u USING ({keys}))"""


def nearest(name: str, k: int) -> str:
    """The k nearest of each point of a line, which lie within k places on either side."""
    return f"""SELECT p.point_id AS i, o.w, (p.a - o.a) * (p.a - o.a) AS d2, row_number() OVER (PARTITION BY p.point_id ORDER BY (p.a - o.a) * (p.a - o.a), o.point_id) AS r
  FROM {name} p, generate_series(-{k}, {k}) AS g(shift) JOIN {name} o ON o.pos = p.pos + g.shift QUALIFY r <= {k}"""


def knee(name: str, k: int) -> str:
    """eps: the knee of the distances at which the k nearest weigh k."""
    return f"""kn AS ({nearest(name, k)}),
kc AS (SELECT i, d2, sum(w) OVER (PARTITION BY i ORDER BY r) AS cum FROM kn), kd AS (SELECT sqrt(min(d2)) AS k FROM kc WHERE cum >= {k} GROUP BY i),
kr AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS x FROM kd), ke AS (SELECT min(k) AS lo, max(k) AS hi, count(*) AS n FROM kd),
eps AS MATERIALIZED (SELECT k AS epsilon FROM kr, ke ORDER BY abs((hi - lo) * x - (n - 1) * (k - lo)) DESC, x LIMIT 1)"""


def ordering(name: str, min_pts: int, axes: tuple[str, ...] = ("a",)) -> str:
    """step(id, ord, reach): the ordering as a keyed recursion, with the radius of eps; each
    step settles the point that was last placed."""
    d2 = " + ".join(f"(p.{c} - o.{c}) * (p.{c} - o.{c})" for c in axes)
    return f"""near AS MATERIALIZED (SELECT p.point_id AS i, o.point_id AS j, o.w, {d2} AS d2 FROM {name} p JOIN {name} o ON o.{axes[0]} BETWEEN p.{axes[0]} - (SELECT epsilon FROM eps) AND p.{axes[0]} + (SELECT epsilon FROM eps) WHERE {d2} < (SELECT epsilon * epsilon FROM eps)),
cum AS (SELECT i, d2, sum(w) OVER (PARTITION BY i ORDER BY d2, j) AS cum FROM near), core AS MATERIALIZED (SELECT i, sqrt(min(d2)) AS c FROM cum WHERE cum >= {min_pts} GROUP BY i),
arc AS MATERIALIZED (SELECT n.i, n.j, greatest(c.c, sqrt(n.d2)) AS v FROM near n JOIN core c ON c.i = n.i),
step(id, ord, reach) USING KEY (id) AS (
  SELECT point_id, CASE WHEN point_id = 0 THEN 0 ELSE -1 END::BIGINT, (-1)::DOUBLE FROM {name}
  UNION
  (WITH last AS (SELECT id, ord FROM recurring.step ORDER BY ord DESC LIMIT 1),
  rel AS (SELECT s.id, least(CASE WHEN s.reach < 0 THEN 1e300::DOUBLE ELSE s.reach END, n.v) AS reach FROM last JOIN arc n ON n.i = last.id JOIN recurring.step s ON s.id = n.j WHERE s.ord < 0),
  now AS (SELECT s.id, coalesce(rel.reach, s.reach) AS reach FROM recurring.step s LEFT JOIN rel ON rel.id = s.id WHERE s.ord < 0),
  nxt AS (SELECT id FROM now ORDER BY (reach < 0), reach, id LIMIT 1)
  SELECT now.id, CASE WHEN now.id = nxt.id THEN last.ord + 1 ELSE -1 END::BIGINT, now.reach FROM now, nxt, last WHERE now.id = nxt.id OR now.id IN (SELECT id FROM rel)))"""


def steep_areas(name: str, chi: float, least: int) -> str:
    """xi(cluster_id, b, e): ranges of the ordering in order of emission.

    Steep points chain into areas as islands: two in a row belong together if the plot doesn't
    turn between them and less than `least` weight lies between. The scan keeps the open
    descents in a list; ranges are cut to equal heights afterwards."""
    ends = lambda kind, turn: f"""{kind}_steps AS (SELECT *, lead(i) OVER (ORDER BY i) AS q, lead(filled) OVER (ORDER BY i) AS qf, lead({turn}) OVER (ORDER BY i) AS qt FROM pts WHERE {kind}),
{kind}_isles AS (SELECT *, coalesce(sum(CASE WHEN q IS NOT NULL AND (qf - filled >= {least} OR qt <> {turn}) THEN 1 ELSE 0 END) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS isle FROM {kind}_steps),
{kind}_ends AS (SELECT x.i, CASE WHEN y.q IS NULL AND z.filled - y.filled < {least} AND z.{turn} = y.{turn} THEN greatest(z.n - 2, y.i) ELSE y.i END AS last FROM {kind}_isles x JOIN (SELECT isle, max(i) AS i FROM {kind}_isles GROUP BY isle) m USING (isle) JOIN {kind}_isles y ON y.i = m.i, pts z WHERE z.i = z.n - 1)"""  # noqa: E731
    return f"""plot0 AS (SELECT s.ord AS i, s.reach, c.w, count(*) OVER () AS n, coalesce(max(s.reach) FILTER (WHERE s.reach >= 0) OVER (), 0) AS top FROM step s JOIN {name} c ON c.point_id = s.id),
plot1 AS (SELECT i, n, top, w, CASE WHEN i = 0 THEN top WHEN reach < 0 THEN 2 * top ELSE reach END AS h FROM plot0),
plot2 AS (SELECT *, coalesce(lead(h) OVER (ORDER BY i), top) AS aft, lag(h) OVER (ORDER BY i) AS bef, (sum(w) OVER (ORDER BY i) - w)::BIGINT AS filled FROM plot1),
pts AS MATERIALIZED (SELECT i, n, h, aft, filled, i = 0 OR (i < n - 1 AND aft <= h * (1 - {chi}::DOUBLE)) AS falls, i = n - 1 OR aft * (1 - {chi}::DOUBLE) >= h AS rises,
  sum((coalesce(h > bef, false))::INT) OVER (ORDER BY i) AS ups, sum((coalesce(h < bef, false))::INT) OVER (ORDER BY i) AS downs FROM plot2),
{ends('falls', 'ups')},
{ends('rises', 'downs')},
spots AS MATERIALIZED (SELECT p.*, coalesce(CASE WHEN falls THEN f.last ELSE r.last END, p.i) AS last, falls OR rises AS steep FROM pts p LEFT JOIN falls_ends f ON f.i = p.i LEFT JOIN rises_ends r ON r.i = p.i),
spot AS MATERIALIZED (SELECT a.i, a.n, a.h, a.falls, a.steep, a.last, e.aft AS beyond, m.filled AS mid FROM spots a JOIN spots e ON e.i = a.last JOIN spots m ON m.i = (a.i + a.last) // 2),
scan(k, i, high, open, shut) AS (
  SELECT 0::BIGINT, 0::BIGINT, 0::DOUBLE, []::STRUCT(b BIGINT, e BIGINT, h DOUBLE, mid BIGINT, high DOUBLE)[], []::STRUCT(b BIGINT, e BIGINT, h DOUBLE, mid BIGINT, high DOUBLE)[]
  UNION ALL
  SELECT k + 1, CASE WHEN steep AND big THEN last + 1 ELSE i + 1 END, CASE WHEN NOT steep THEN greatest(high, h) WHEN big AND last < n - 1 THEN beyond ELSE top END,
    CASE WHEN NOT steep THEN open WHEN big AND falls THEN list_append(kept, {{'b': i, 'e': last, 'h': h, 'mid': mid, 'high': 0::DOUBLE}}) ELSE kept END,
    CASE WHEN steep AND big AND NOT falls THEN list_filter(kept, lambda x: x.high <= beyond * (1 - {chi}::DOUBLE) AND mid - x.mid >= {least} - 2) ELSE [] END
  FROM (SELECT *, list_transform(list_filter(open, lambda x: top <= x.h * (1 - {chi}::DOUBLE)), lambda x: {{'b': x.b, 'e': x.e, 'h': x.h, 'mid': x.mid, 'high': greatest(x.high, top)}}) AS kept, CASE WHEN falls THEN h >= beyond ELSE h <= beyond END AS big
    FROM (SELECT s.k, s.open, s.high, p.*, CASE WHEN falls THEN greatest(s.high, h) ELSE s.high END AS top FROM scan s JOIN spot p ON p.i = s.i))),
met AS (SELECT k, generate_subscripts(shut, 1) AS pos, unnest(shut) AS d FROM scan WHERE len(shut) > 0),
rise AS (SELECT m.k, m.pos, m.d.b AS b, m.d.e AS e, m.d.h AS z, p.i AS r, p.last, p.n, q.h AS y FROM met m JOIN scan s ON s.k = m.k - 1 JOIN spot p ON p.i = s.i JOIN spots q ON q.i = least(p.last + 1, p.n - 1)),
xi AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY k, pos) - 1)::BIGINT AS cluster_id,
  CASE WHEN abs(z - y) <= z * {chi}::DOUBLE OR z <= y THEN b ELSE coalesce((SELECT min(t.i) FROM spots t WHERE t.i > rise.b AND t.i <= rise.e AND t.h <= rise.y), e + 1) - 1 END AS b,
  CASE WHEN abs(z - y) <= z * {chi}::DOUBLE OR z > y THEN last ELSE coalesce((SELECT max(t.i) FROM spots t WHERE t.i >= rise.r AND t.i <= rise.last AND t.h < rise.z), r - 1) + 1 END AS e FROM rise)"""


TREE = """inner_of AS MATERIALIZED (SELECT x.cluster_id AS k, x.b, x.e, coalesce((SELECT min(y.cluster_id) FROM xi y WHERE y.cluster_id > x.cluster_id AND y.e > x.e), (SELECT count(*) FROM xi)) - x.cluster_id - 1 AS inside FROM xi x),
put(k, taken, place) AS (
  SELECT -1::BIGINT, []::BIGINT[], -1::BIGINT
  UNION ALL
  SELECT k + 1, list_append(taken, spot), spot FROM (SELECT p.k, p.taken, i.inside + (SELECT min(f.g) FROM (SELECT unnest(range(0, 1 + len(p.taken)::BIGINT)) AS g) f WHERE NOT list_contains(p.taken, f.g)) AS spot FROM put p JOIN inner_of i ON i.k = p.k + 1)),
node AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY place) - 1)::BIGINT AS node_id, b, e FROM (SELECT place, max(k) AS k FROM put WHERE k >= 0 GROUP BY place) JOIN inner_of USING (k)),
child AS MATERIALIZED (SELECT c.node_id, c.b, c.e, (SELECT min(p.node_id) FROM node p WHERE p.node_id > c.node_id AND p.b <= c.b AND p.e >= c.e) AS parent_id FROM node c),
deep(node_id, depth) AS (SELECT node_id, 0 FROM child WHERE parent_id IS NULL UNION ALL SELECT c.node_id, d.depth + 1 FROM child c JOIN deep d ON c.parent_id = d.node_id)"""


def labels(members: str, rows: str, least: str) -> str:
    """label of every row: clusters of `least` rows or more by their id, a row in several by the
    last one; members (cluster_id, row_id)."""
    return f"""kept AS (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) - 1 AS label FROM {members} GROUP BY cluster_id HAVING count(*) >= {least}),
given AS (SELECT row_id, max(label) AS label FROM {members} JOIN kept USING (cluster_id) GROUP BY row_id)
SELECT r.point_id, coalesce(g.label, -1)::BIGINT AS label FROM {rows} r LEFT JOIN given g ON g.row_id = r.point_id"""


def spanning_tree(name: str, k: int) -> str:
    """tree(s, id, d): the mutual-reachability tree of the whole graph grown from point 0; the
    nearest point comes next, the smaller id first, from the point that reached it first."""
    return f"""pn AS ({nearest(name, k)}),
pc AS (SELECT i, d2, sum(w) OVER (PARTITION BY i ORDER BY r) AS cum FROM pn), pm AS (SELECT i, sqrt(min(d2)) AS c FROM pc WHERE cum >= {k} GROUP BY i),
body AS MATERIALIZED (SELECT p.point_id AS id, p.a, p.w, coalesce(pm.c, 0::DOUBLE) AS c FROM {name} p LEFT JOIN pm ON pm.i = p.point_id),
grow(id, d, s, taken) USING KEY (id) AS (
  SELECT id, 1e300::DOUBLE, 0::BIGINT, CASE WHEN id = 0 THEN 0 ELSE -1 END::BIGINT FROM body
  UNION
  (WITH last AS (SELECT g.id, g.taken, b.a, b.c FROM recurring.grow g JOIN body b USING (id) ORDER BY g.taken DESC LIMIT 1),
  far AS (SELECT g.id, g.d, g.s, greatest(b.c, last.c, sqrt((b.a - last.a) * (b.a - last.a))) AS x, last.id AS l FROM recurring.grow g JOIN body b USING (id), last WHERE g.taken < 0),
  now AS (SELECT id, least(d, x) AS d, CASE WHEN x < d THEN l ELSE s END AS s, x < d AS moved FROM far),
  nxt AS (SELECT id FROM now ORDER BY d, id LIMIT 1)
  SELECT now.id, now.d, now.s, CASE WHEN now.id = nxt.id THEN last.taken + 1 ELSE -1 END::BIGINT FROM now, nxt, last WHERE now.moved OR now.id = nxt.id)),
tree AS MATERIALIZED (SELECT s, id, d FROM grow WHERE taken > 0)"""


def hierarchy(least: int) -> str:
    """fall(parent, child, lvl, size): the condensed tree of `tree`, with `body` as points; and
    mass(c, stability), the stability of each cluster."""
    return f"""many AS MATERIALIZED (SELECT count(*)::BIGINT AS n FROM body),
edge AS MATERIALIZED (SELECT least(s, id) AS u, greatest(s, id) AS v, d, (row_number() OVER (ORDER BY d, least(s, id), greatest(s, id)) - 1)::BIGINT AS k FROM tree),
join_(id, node, k, lo, hi) USING KEY (id) AS (
  SELECT id, id, -1::BIGINT, NULL::BIGINT, NULL::BIGINT FROM body
  UNION
  (WITH now AS (SELECT max(k) + 1 AS k FROM recurring.join_), e AS (SELECT edge.* FROM edge JOIN now USING (k)),
  two AS (SELECT e.k, x.node AS xn, y.node AS yn FROM e JOIN recurring.join_ x ON x.id = e.u AND x.lo IS NULL JOIN recurring.join_ y ON y.id = e.v AND y.lo IS NULL)
  SELECT j.id, m.n + two.k, two.k, NULL, NULL FROM recurring.join_ j, two, many m WHERE j.lo IS NULL AND j.node IN (two.xn, two.yn)
  UNION ALL SELECT m.n + two.k, m.n + two.k, two.k, two.xn, two.yn FROM two, many m)),
merge_ AS MATERIALIZED (SELECT j.id AS node, j.lo, j.hi, e.d FROM join_ j JOIN edge e ON e.k = j.id - (SELECT n FROM many) WHERE j.lo IS NOT NULL),
below(top, node) AS (SELECT node, node FROM (SELECT node FROM merge_ UNION ALL SELECT id FROM body) UNION ALL SELECT b.top, unnest([m.lo, m.hi]) FROM below b JOIN merge_ m ON m.node = b.node),
leaf AS MATERIALIZED (SELECT b.top, b.node AS id, p.w FROM below b JOIN body p ON p.id = b.node), weigh AS MATERIALIZED (SELECT top AS node, sum(w)::BIGINT AS size FROM leaf GROUP BY top),
side AS MATERIALIZED (SELECT m.node, CASE WHEN m.d > 0 THEN 1 / m.d ELSE 'inf'::DOUBLE END AS lvl, s.side, s.sub, z.size, sum((z.size >= {least})::INT) OVER (PARTITION BY m.node) AS large FROM merge_ m, LATERAL (SELECT 0 AS side, m.lo AS sub UNION ALL SELECT 1, m.hi) s JOIN weigh z ON z.node = s.sub),
go(depth, pos, node, c, fresh) AS (
  SELECT 0::BIGINT, 0::BIGINT, 2 * n - 2, n, n + 1 FROM many
  UNION ALL
  SELECT g.depth + 1, row_number() OVER (ORDER BY g.pos, s.side), s.sub,
    CASE WHEN s.large = 2 THEN g.fresh + sum(CASE WHEN s.large = 2 THEN 1 ELSE 0 END) OVER (ORDER BY g.pos, s.side) - 1 ELSE g.c END::BIGINT,
    (g.fresh + sum(CASE WHEN s.large = 2 THEN 1 ELSE 0 END) OVER ())::BIGINT
  FROM go g JOIN side s ON s.node = g.node WHERE s.size >= {least}),
walk AS MATERIALIZED (SELECT node, c FROM go),
fall AS MATERIALIZED (SELECT w.c AS parent, x.c AS child, s.lvl, s.size FROM walk w JOIN side s ON s.node = w.node JOIN walk x ON x.node = s.sub WHERE s.large = 2
  UNION ALL SELECT w.c, l.id, s.lvl, l.w FROM walk w JOIN side s ON s.node = w.node JOIN leaf l ON l.top = s.sub WHERE s.size < {least}),
mass AS MATERIALIZED (SELECT f.parent AS c, sum(CASE WHEN isnan(gain) THEN 0 ELSE gain END) AS stability FROM (SELECT f.parent, (f.lvl - coalesce(b.lvl, 0)) * f.size AS gain FROM fall f LEFT JOIN fall b ON b.child = f.parent AND b.child >= (SELECT n FROM many)) f GROUP BY f.parent)"""


def chosen_clusters(method: str = "eom", single: bool = False) -> str:
    """pick(c): the selected clusters of the condensed tree."""
    split = "split AS MATERIALIZED (SELECT parent, child FROM fall, many WHERE child >= n)"
    root = "true" if single else "m.c <> n"
    if method == "leaf":
        return f"{split}, pick AS MATERIALIZED (SELECT m.c FROM mass m, many WHERE m.c NOT IN (SELECT parent FROM split) AND {root})"
    return f"""{split}, rank_ AS MATERIALIZED (SELECT c, stability, row_number() OVER (ORDER BY c DESC) AS k FROM mass),
best(c, mass, wins, k) USING KEY (c) AS (
  SELECT n + 1000000000000, 0::DOUBLE, false, 0::BIGINT FROM many
  UNION
  (WITH now AS (SELECT r.* FROM rank_ r WHERE r.k = (SELECT max(k) + 1 FROM recurring.best)),
  kids AS (SELECT coalesce(sum(b.mass), 0) AS together FROM now JOIN split s ON s.parent = now.c JOIN recurring.best b ON b.c = s.child)
  SELECT now.c, greatest(now.stability, together), NOT (together > now.stability) AND ({'true' if single else 'now.c <> n'}), now.k FROM now, kids, many)),
reach_(c) AS (SELECT n FROM many UNION ALL SELECT s.child FROM reach_ r JOIN best b ON b.c = r.c JOIN split s ON s.parent = r.c WHERE NOT b.wins),
pick AS MATERIALIZED (SELECT b.c FROM reach_ JOIN best b USING (c) WHERE b.wins)"""


MEMBERSHIP = """tag AS MATERIALIZED (SELECT c, (row_number() OVER (ORDER BY c) - 1)::BIGINT AS label FROM pick),
under(c, label) AS (SELECT c, label FROM tag UNION ALL SELECT s.child, u.label FROM under u JOIN split s ON s.parent = u.c),
got AS MATERIALIZED (SELECT f.child AS id, u.label, f.lvl FROM fall f JOIN under u ON u.c = f.parent, many WHERE f.child < n),
most AS (SELECT label, coalesce(max(lvl) FILTER (WHERE NOT isinf(lvl)), 0) AS top FROM got GROUP BY label),
member AS MATERIALIZED (SELECT b.id, coalesce(g.label, -1)::BIGINT AS label, CASE WHEN g.label IS NULL THEN 0 WHEN m.top > 0 AND NOT isinf(g.lvl) THEN least(g.lvl, m.top) / m.top ELSE 1 END::DOUBLE AS probability FROM body b LEFT JOIN got g ON g.id = b.id LEFT JOIN most m ON m.label = g.label)"""


def neighbour_tree(name: str, k: int, m: int) -> str:
    """tree(s, id, d): the tree of the mutual-reachability graph of the k nearest in the plane,
    edges by weight and ids; components that are left hang on point 0."""
    d2 = "(p.a - o.a) * (p.a - o.a) + (p.b - o.b) * (p.b - o.b)"
    return f"""body AS MATERIALIZED (SELECT point_id AS id, w FROM {name}),
nb AS MATERIALIZED (SELECT p.point_id AS i, o.point_id AS j, o.w, {d2} AS d2, row_number() OVER (PARTITION BY p.point_id ORDER BY {d2}, o.point_id) AS r FROM {name} p, {name} o QUALIFY r <= {k}),
nc AS (SELECT i, d2, sum(w) OVER (PARTITION BY i ORDER BY r) AS cum FROM nb), nd AS MATERIALIZED (SELECT i, sqrt(coalesce(min(d2) FILTER (WHERE cum >= {m}), max(d2))) AS c FROM nc GROUP BY i),
line AS MATERIALIZED (SELECT DISTINCT least(n.i, n.j) AS u, greatest(n.i, n.j) AS v, greatest(x.c, y.c, sqrt(n.d2)) AS d FROM nb n JOIN nd x ON x.i = n.i JOIN nd y ON y.i = n.j WHERE n.i <> n.j),
way AS MATERIALIZED (SELECT u AS x, v AS y, {{'d': d, 'u': u, 'v': v}} AS e FROM line UNION ALL SELECT v, u, {{'d': d, 'u': u, 'v': v}} FROM line),
spread(id, e, taken) USING KEY (id) AS (
  SELECT id, {{'d': 1e300::DOUBLE, 'u': 0::BIGINT, 'v': id}}, CASE WHEN id = 0 THEN 0 ELSE -1 END::BIGINT FROM body
  UNION
  (WITH last AS (SELECT id, taken FROM recurring.spread ORDER BY taken DESC LIMIT 1),
  better AS (SELECT s.id, min(w.e) AS e FROM last JOIN way w ON w.x = last.id JOIN recurring.spread s ON s.id = w.y WHERE s.taken < 0 AND w.e < s.e GROUP BY s.id),
  now AS (SELECT s.id, coalesce(b.e, s.e) AS e, b.id IS NOT NULL AS moved FROM recurring.spread s LEFT JOIN better b ON b.id = s.id WHERE s.taken < 0),
  nxt AS (SELECT id FROM now ORDER BY e, id LIMIT 1)
  SELECT now.id, now.e, CASE WHEN now.id = nxt.id THEN last.taken + 1 ELSE -1 END::BIGINT FROM now, nxt, last WHERE now.moved OR now.id = nxt.id)),
bridge AS (SELECT CASE WHEN max(e.d) > 0 THEN 2 * max(e.d) ELSE 1 END + 1 AS far FROM spread WHERE taken > 0 AND e.d < 1e300),
tree AS MATERIALIZED (SELECT e.u AS s, e.v AS id, CASE WHEN e.d < 1e300 THEN e.d ELSE far END AS d FROM spread, bridge WHERE taken > 0)"""
