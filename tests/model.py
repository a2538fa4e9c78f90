"""A plain, single-threaded rendering of the traversal, for comparison: stored stacks are searched one by one."""

from collections import Counter, defaultdict, deque


def suffix(inner, outer):
    return not outer if not inner else len(inner) <= len(outer) and outer[len(outer) - len(inner) :] == inner


def flows(nodes, edges, order):
    """nodes: id -> (kind, component, class); edges: (src, dst, component, step, data); order: workflows."""
    stored = defaultdict(list)
    found = Counter()
    leaving = defaultdict(list)
    for src, dst, component, step, data in sorted(edges, key=lambda e: (e[1], e[3], e[4])):
        leaving[src, component].append((dst, step, data))
    done = lambda n, c, s: any(suffix(c, x) and suffix(s, y) for x, y in stored[n])
    for w in order:
        queue = deque((n, [], [], 0, {}) for n in sorted(k for k, v in nodes.items() if v == ("InParameter", w, "Workflow")))
        while queue:
            n, cs, ss, depth, seen = queue.popleft()
            kind, c, t = nodes[n]
            if kind == "InParameter":
                cs = [*cs, (c, t)]
                seen = {**seen, c: depth}
                outer = [x for x, k in cs if k == "Workflow"]
                for x, at in seen.items():
                    if x != c and x not in outer:
                        for o in outer:
                            if at > seen[o]:
                                found[x, c, o, "Sequential" if depth - at == 1 else "Transitive", depth - at] += 1
                for i, o in enumerate(outer):
                    k = len(outer) - i
                    if o != c and not done(n, cs[-k:], ss[-k:]):
                        found[o, c, o, "Direct", 1] += 1
                if t != "Workflow":
                    depth += 1
            if not cs:
                continue
            if kind == "OutParameter":
                cs = cs[:-1]
                outer = [x for x, k in cs if k == "Workflow"]
                for i, o in enumerate(outer):
                    k = len(outer) - i
                    if o != c and not done(n, cs[-k:], ss[-k:]):
                        found[c, o, o, "Indirect", 1] += 1
                if t == "Workflow":
                    seen = {**seen, c: depth - 1}
            if not cs or done(n, cs, ss):
                continue
            stored[n].append((cs, ss))
            top, top_class = cs[-1]
            prefix = None
            if top_class == "Workflow" and ss and kind != "InParameter":
                prefix, ss = ss[-1] + "/", ss[:-1]
            for dst, step, data in leaving[n, top]:
                if prefix is None or data.startswith(prefix):
                    queue.append((dst, cs, [*ss, step] if step else ss, depth, seen))
    return found
