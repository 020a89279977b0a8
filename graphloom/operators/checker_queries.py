"""The checkers' queries, with SQL that follows ways through the graph one variable at a time."""

from __future__ import annotations

from graphloom.operators import checkers
from graphloom.operators.graph_queries import AVOID, I, facts, kernel
from graphloom.registry import query

ACTS = "act AS (SELECT fn, b, et, v::BIGINT AS v FROM blk WHERE et IN ('signup', 'purchase', 'click') AND v IS NOT NULL), vars AS (SELECT DISTINCT fn, v FROM act)"


def may(name: str, on: str, off: str, first: bool) -> str:
    """SQL for variables that may be on before a block: on from the entry or from a block that turns them on, until one turns them off."""
    start = "SELECT fn, 1::BIGINT AS b, v FROM vars UNION " if first else ""
    return f"{name} AS ({start}SELECT act.fn, e.d AS b, act.v FROM act JOIN e ON e.fn = act.fn AND e.s = act.b WHERE act.et = '{on}' UNION SELECT {name}.fn, e.d, {name}.v FROM {name} JOIN e ON e.fn = {name}.fn AND e.s = {name}.b WHERE NOT EXISTS (SELECT 1 FROM act WHERE act.fn = {name}.fn AND act.b = {name}.b AND act.v = {name}.v AND act.et = '{off}'))"


ON, OFF = may("mon", "purchase", "signup", False), may("moff", "signup", "purchase", True)
HELD, FREE = may("held", "signup", "purchase", False), may("free", "purchase", "signup", True)


@query("move_check", I + ACTS + ", " + ON + ", " + OFF + " SELECT fn, b, v, CASE WHEN EXISTS (SELECT 1 FROM moff m WHERE m.fn = act.fn AND m.b = act.b AND m.v = act.v) THEN 'possible' ELSE 'certain' END AS verdict FROM act WHERE et = 'click' AND EXISTS (SELECT 1 FROM mon m WHERE m.fn = act.fn AND m.b = act.b AND m.v = act.v)")
def _(spark, d):
    return checkers.moves(facts(spark, d))


@query("lock_check", I + ACTS + ", " + HELD + ", " + FREE + " SELECT fn, b, v, 'double acquire' AS what FROM act JOIN held USING (fn, b, v) WHERE et = 'signup' UNION ALL SELECT fn, b, v, 'release unheld' FROM act JOIN free USING (fn, b, v) WHERE et = 'purchase' UNION ALL SELECT fn, b, v, 'use unlocked' FROM act JOIN free USING (fn, b, v) WHERE et = 'click'")
def _(spark, d):
    return checkers.locks(facts(spark, d))


@query("called_once", I + ACTS + ", called AS (SELECT DISTINCT fn, v FROM act WHERE et = 'purchase'), w AS (SELECT c.fn, c.v, 1::BIGINT AS b, CASE WHEN a.v IS NULL THEN 0 ELSE 1 END AS n FROM called c LEFT JOIN act a ON a.fn = c.fn AND a.v = c.v AND a.b = 1 AND a.et = 'purchase' UNION SELECT w.fn, w.v, e.d, least(2, n + CASE WHEN a.v IS NULL THEN 0 ELSE 1 END) FROM w JOIN e ON e.fn = w.fn AND e.s = w.b LEFT JOIN act a ON a.fn = e.fn AND a.b = e.d AND a.v = w.v AND a.et = 'purchase'), o AS (SELECT w.fn, w.v, bool_or(w.n = 0) AS zero, bool_or(w.n = 1) AS one, bool_or(w.n = 2) AS more FROM w JOIN blk ON blk.fn = w.fn AND blk.b = w.b WHERE blk.b = blk.n GROUP BY w.fn, w.v) SELECT fn, v, zero, one, more, CASE WHEN more THEN 'more than once' WHEN one AND zero THEN 'not on every way' WHEN one THEN 'once' ELSE 'never' END AS verdict FROM o")
def _(spark, d):
    return checkers.called_once(facts(spark, d))


@query("unchecked_access", I + ACTS + ", " + AVOID + " SELECT fn, b, v FROM act WHERE et = 'click' AND NOT EXISTS (SELECT 1 FROM dom JOIN act c ON c.fn = dom.fn AND c.b = dom.dom AND c.et = 'signup' WHERE dom.fn = act.fn AND dom.b = act.b AND c.v = act.v)")
def _(spark, d):
    return checkers.unchecked(facts(spark, d))


STATES = may("sc", "purchase", "signup", False) + ", " + may("sw", "signup", "purchase", False) + ", su AS (SELECT fn, 1::BIGINT AS b, v FROM vars UNION SELECT su.fn, e.d, su.v FROM su JOIN e ON e.fn = su.fn AND e.s = su.b WHERE NOT EXISTS (SELECT 1 FROM act WHERE act.fn = su.fn AND act.b = su.b AND act.v = su.v AND act.et IN ('signup', 'purchase')))"
HAS = "EXISTS (SELECT 1 FROM {0} x WHERE x.fn = act.fn AND x.b = act.b AND x.v = act.v)"
kernel("typestate", checkers.typestates, I + ACTS + ", " + STATES + " SELECT fn, b, v, concat_ws('|', " + ", ".join(f"CASE WHEN {HAS.format(t)} THEN '{n}' END" for t, n in (("sc", "consumed"), ("su", "unknown"), ("sw", "whole"))) + ") AS states FROM act WHERE et = 'click'")
kernel("expired_loans", checkers.expired_loans, I + ACTS + ", ln AS (SELECT act.fn, act.b AS issue, act.v, e.d AS b, false AS over FROM act JOIN e ON e.fn = act.fn AND e.s = act.b WHERE et = 'signup' UNION SELECT ln.fn, ln.issue, ln.v, e.d, ln.over OR EXISTS (SELECT 1 FROM act WHERE act.fn = ln.fn AND act.b = ln.b AND act.v = ln.v AND act.et = 'purchase') FROM ln JOIN e ON e.fn = ln.fn AND e.s = ln.b WHERE NOT EXISTS (SELECT 1 FROM act WHERE act.fn = ln.fn AND act.b = ln.b AND act.v = ln.v AND act.et = 'signup')) SELECT ln.fn, issue, ln.b, ln.v, CASE WHEN bool_and(over) THEN 'definite' ELSE 'maybe' END AS confidence FROM ln JOIN act ON act.fn = ln.fn AND act.b = ln.b AND act.v = ln.v AND act.et = 'click' GROUP BY ln.fn, issue, ln.b, ln.v HAVING bool_or(over)")
MOVES = I + ACTS + ", " + ON + ", " + OFF + ", mv AS (SELECT fn, b, v, CASE WHEN EXISTS (SELECT 1 FROM moff m WHERE m.fn = act.fn AND m.b = act.b AND m.v = act.v) THEN 'possible' ELSE 'certain' END AS verdict FROM act WHERE et = 'click' AND EXISTS (SELECT 1 FROM mon m WHERE m.fn = act.fn AND m.b = act.b AND m.v = act.v))"
kernel("leading_reports", checkers.leading_reports, MOVES + ", " + AVOID + " SELECT * FROM mv WHERE NOT EXISTS (SELECT 1 FROM mv o JOIN dom ON dom.fn = o.fn AND dom.dom = o.b WHERE o.fn = mv.fn AND o.v = mv.v AND o.b <> mv.b AND dom.b = mv.b)")
kernel("unit_status", lambda f: checkers.unit_status(f, 20_000), MOVES + " SELECT fn, CASE WHEN NOT bool_or(et = 'purchase' AND v IS NOT NULL) THEN 'skip:no-move' WHEN (SELECT count(*) FROM mv WHERE mv.fn = blk.fn) > 0 THEN 'found' ELSE 'clean' END AS status, CASE WHEN bool_or(et = 'purchase' AND v IS NOT NULL) THEN (SELECT count(*) FROM mv WHERE mv.fn = blk.fn) ELSE 0 END AS reports FROM blk GROUP BY fn")
kernel("analysis_log", checkers.log)
