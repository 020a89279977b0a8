"""Orders, components, dominance and loops of one directed graph, for kernels that run on a whole (bounded) graph at a time.

A graph is a dict from node to the list of its successors in recorded order. Nothing recurses, so that depth is bounded by memory only.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Hashable, Iterable

import numpy as np

Node = Hashable
Graph = dict


def graph(nodes: Iterable[Node], edges: Iterable[tuple[Node, Node]]) -> Graph:
    out: Graph = {n: [] for n in nodes}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    return out


def reverse(g: Graph) -> Graph:
    out: Graph = {n: [] for n in g}
    for a, next_ in g.items():
        for b in next_:
            out[b].append(a)
    return out


def depth_first(g: Graph, roots: Iterable[Node], children: Callable = list) -> tuple[list, list, list]:
    """Nodes as entered, nodes as left, and edges into a node that is still open (whose removal leaves no cycle)."""
    pre, post, back, state = [], [], [], {}
    for root in roots:
        if root in state:
            continue
        state[root] = 1
        pre.append(root)
        stack = [(root, iter(children(g[root])))]
        while stack:
            node, rest = stack[-1]
            for child in rest:
                if child not in state:
                    state[child] = 1
                    pre.append(child)
                    stack.append((child, iter(children(g[child]))))
                    break
                if state[child] == 1:
                    back.append((node, child))
            else:
                stack.pop()
                state[node] = 2
                post.append(node)
    return pre, post, back


def reverse_post_order(g: Graph, roots: Iterable[Node], children: Callable = list) -> list:
    return depth_first(g, roots, children)[1][::-1]


def levels(g: Graph, roots: Iterable[Node]) -> dict:
    """Breadth-first distance from the nearest root."""
    out = {r: 0 for r in roots}
    queue = deque(out)
    while queue:
        a = queue.popleft()
        for b in g[a]:
            if b not in out:
                out[b] = out[a] + 1
                queue.append(b)
    return out


def shortest_chain(g: Graph, source: Node, goal: Callable[[Node], bool], allowed: Callable[[Node], bool] = lambda _: True) -> list | None:
    """The first chain of at least one edge that a breadth-first search in recorded order finds; the source may be its own goal."""
    parent: dict = {}
    queue = deque([source])
    while queue:
        a = queue.popleft()
        for b in g[a]:
            if not allowed(b) or b in parent:
                continue
            parent[b] = a
            if goal(b):
                chain = [b]
                while True:
                    chain.append(parent[chain[-1]])
                    if chain[-1] == source:
                        return chain[::-1]
            queue.append(b)
    return None


def components(g: Graph) -> list[list]:
    """Strongly connected components, those that others lead to first; members ascending."""
    index, low, on, stack, out = {}, {}, set(), [], []
    for root in g:
        if root in index:
            continue
        work = [(root, iter(g[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for child in rest:
                if child not in index:
                    index[child] = low[child] = len(index)
                    stack.append(child)
                    on.add(child)
                    work.append((child, iter(g[child])))
                    break
                if child in on:
                    low[node] = min(low[node], index[child])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    members = []
                    while not members or members[-1] != node:
                        members.append(stack.pop())
                        on.discard(members[-1])
                    out.append(sorted(members))
    return out


def strong(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of the nodes 0 to n - 1 the smallest of its strongly connected component; edges a - b. Edges that start where none ends, or end where none starts, are in no cycle and go first, in some turns."""
    for _ in range(20):
        keep = (np.bincount(a, minlength=n) > 0)[b] & (np.bincount(b, minlength=n) > 0)[a]
        if keep.all():
            break
        a, b = a[keep], b[keep]
    label, ids = np.arange(n), np.union1d(a, b)
    a, b, m = np.searchsorted(ids, a), np.searchsorted(ids, b), len(ids)
    by = np.argsort(a, kind="stable")
    to, start = b[by].tolist(), np.searchsorted(a[by], np.arange(m + 1)).tolist()
    at, end = start[:-1], start[1:]
    index, low, least, stack = [0] * m, [0] * m, list(range(m)), []
    count, done = 0, m + 1
    for root in range(m):
        if index[root]:
            continue
        work = [root]
        while work:
            node = work[-1]
            if not index[node]:
                count += 1
                index[node] = low[node] = count
                stack.append(node)
            k = at[node]
            if k < end[node]:
                at[node] = k + 1
                child = to[k]
                if not index[child]:
                    work.append(child)
                elif index[child] < low[node]:
                    low[node] = index[child]
                continue
            work.pop()
            if low[node] < index[node]:
                low[work[-1]] = min(low[work[-1]], low[node])
                continue
            members = [stack.pop()]
            while members[-1] != node:
                members.append(stack.pop())
            first = min(members)
            for x in members:
                index[x], least[x] = done, first
    label[ids] = ids[np.array(least, dtype=np.int64)]
    return label


def cyclic(g: Graph, members: list) -> bool:
    return len(members) > 1 or members[0] in g[members[0]]


def heights(g: Graph) -> dict:
    """Longest chain down to a leaf; None for members of a cycle, which count as 1 for those that call them."""
    out: dict = {}
    for members in components(g):
        if cyclic(g, members):
            out.update(dict.fromkeys(members))
        else:
            (node,) = members
            out[node] = max((1 if out[b] is None else 1 + out[b] for b in g[node]), default=0)
    return out


def immediate_dominators(g: Graph, root: Node) -> dict:
    """Of every node that the root reaches but the root itself; the nearest common ancestor in the tree so far, until it settles."""
    order = reverse_post_order(g, [root])
    rank = {n: k for k, n in enumerate(order)}
    before = reverse(g)
    idom = {root: root}
    changed = True
    while changed:
        changed = False
        for node in order[1:]:
            new = None
            for p in before[node]:
                if p not in idom:
                    continue
                if new is None:
                    new = p
                    continue
                a, b = p, new
                while a != b:
                    while rank[a] > rank[b]:
                        a = idom[a]
                    while rank[b] > rank[a]:
                        b = idom[b]
                new = a
            if idom.get(node) != new:
                idom[node] = new
                changed = True
    del idom[root]
    return idom


def dominators(idom: dict, root: Node) -> dict:
    """All dominators of each reached node, itself included."""
    out = {root: {root}}
    for node in idom:
        path = []
        while node not in out:
            path.append(node)
            node = idom[node]
        for n in reversed(path):
            out[n] = out[idom[n]] | {n}
    return out


def natural_loops(g: Graph, dom: dict) -> dict:
    """The body of each header: the header, and what reaches an edge back to it without passing it."""
    before = reverse(g)
    out: dict = {}
    for tail, next_ in g.items():
        for head in next_:
            if tail in dom and head in dom[tail]:
                body = out.setdefault(head, {head})
                work = [tail]
                while work:
                    n = work.pop()
                    if n not in body:
                        body.add(n)
                        work += [p for p in before[n] if p in dom]
    return out


def frontier(g: Graph, dom: dict) -> dict:
    """n is in the frontier of a if a dominates one that leads to n, and not n itself strictly."""
    out: dict = {}
    for p, next_ in g.items():
        if p in dom:
            for n in next_:
                for a in dom[p]:
                    if a == n or a not in dom[n]:
                        out.setdefault(a, set()).add(n)
    return out


def iterated_frontier(of: dict, seeds: Iterable[Node]) -> set:
    out: set = set()
    work = list(seeds)
    while work:
        for n in of.get(work.pop(), ()):
            if n not in out:
                out.add(n)
                work.append(n)
    return out


def with_virtual_exit(g: Graph, exits: Iterable[Node]) -> tuple[Graph, Node]:
    """The reversed graph from one exit that all given lead to, for post-dominance."""
    end = ("exit",)
    h = {n: list(s) for n, s in g.items()} | {end: []}
    for x in exits:
        h[x].append(end)
    return reverse(h), end


def control_dependence(g: Graph, post_dom: dict) -> set:
    """(block, branch): the branch has an edge whose end the block post-dominates (or is), and the block doesn't post-dominate the branch strictly."""
    return {(b, d) for d, next_ in g.items() if d in post_dom for s in next_ if s in post_dom for b in post_dom[s] if b in g and (b == d or b not in post_dom[d])}


def weak_order(g: Graph, root: Node) -> list | None:
    """Nodes and, nested as lists, components by their heads; None if a cycle has no node that dominates it."""
    dom = dominators(immediate_dominators(g, root), root)
    order = reverse_post_order(g, [root])
    place = {n: k for k, n in enumerate(order)}
    if any(b in place and place[b] <= place[a] and b not in dom[a] for a in order for b in g[a]):
        return None
    loops = natural_loops(g, dom)

    def nest(nodes: list, head: Node | None) -> list:
        out, done = [], set()
        for n in nodes:
            if n in done:
                continue
            if n in loops and n != head:
                inner = [m for m in nodes if m in loops[n]]
                out.append([n, *nest([m for m in inner if m != n], n)])
                done.update(inner)
            else:
                out.append(n)
                done.add(n)
        return out

    return nest(order, None)


def flat(order: list) -> list:
    out = []
    for x in order:
        out += flat(x) if isinstance(x, list) else [x]
    return out
