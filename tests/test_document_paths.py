from collections import defaultdict

from brightwell import catalog
from brightwell.plans import methods

SF = "/root/testdata/sf0.001"


def test_document_paths_against_brute_force(spark):
    near, seeds, want = defaultdict(set), defaultdict(set), set()
    for r in catalog.edge_view(spark, SF).collect():
        near[r.qid, r.src].add(r.dst), near[r.qid, r.dst].add(r.src)
    for r in methods.seeds(methods.scored(catalog.questions(spark, SF), catalog.node_view(spark, SF))).collect():
        seeds[r.qid].add(r.node_ord)

    def walks(q, path, end):
        if path[-1] == end:
            return [path]
        return [p for n in near[q, path[-1]] if n not in path and len(path) <= 3 for p in walks(q, [*path, n], end)]

    for q, nodes in seeds.items():
        for a in nodes:
            for b in nodes:
                if a < b:
                    best = sorted(walks(q, [a], b), key=lambda p: (len(p), p))[:3]
                    want |= {(q, a, b, len(p) - 1, tuple(p), i + 1) for i, p in enumerate(best)}
    got = [(r.qid, r.src, r.dst, r.hops, tuple(r.path), r.path_rank) for r in catalog.document_paths_k(spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want and max(g[3] for g in got) == 3
