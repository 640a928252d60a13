"""The hand-checked five-user data set: 14 training and 9 held-out pairs."""

TRAIN = {1: [1, 3, 4, 5], 2: [1, 3, 6], 3: [2, 4, 6], 4: [1, 2], 5: [3, 6]}
TEST = {1: [1, 6], 2: [2, 3], 3: [1, 5], 4: [1, 6], 5: [2]}
SECOND = [(1, 1), (1, 2), (2, 2), (3, 1), (4, 2), (4, 3), (5, 3)]

USER_SIM = {
    (1, 2): 0.57735026919, (1, 3): 0.288675134595, (1, 4): 0.353553390593, (1, 5): 0.353553390593,
    (2, 3): 0.333333333333, (2, 4): 0.408248290464, (2, 5): 0.816496580928, (3, 4): 0.408248290464,
    (3, 5): 0.408248290464,
}
ITEM_SIM = {
    (1, 2): 0.408248290464, (1, 3): 0.666666666667, (1, 4): 0.408248290464, (1, 5): 0.57735026919,
    (1, 6): 0.333333333333, (2, 4): 0.5, (2, 6): 0.408248290464, (3, 4): 0.408248290464,
    (3, 5): 0.57735026919, (3, 6): 0.666666666667, (4, 5): 0.707106781187, (4, 6): 0.408248290464,
}

USER_TOP2 = {1: [2, 4], 2: [5, 1], 3: [4, 5], 4: [2, 3], 5: [2, 3]}
ITEM_TOP2 = {1: [3, 5], 2: [4, 1], 3: [1, 6], 4: [5, 2], 5: [4, 1], 6: [3, 2]}
USER_TIES2 = {1: {2, 4, 5}, 2: {5, 1}, 3: {4, 5}, 4: {2, 3}, 5: {2, 3}}

# item, votes in rank order for n = 2, k = 3
USER_RECS = {
    1: [(1, 2), (2, 1), (3, 1)], 2: [(3, 2), (1, 1), (4, 1)], 3: [(1, 1), (2, 1), (3, 1)],
    4: [(6, 2), (1, 1), (2, 1)], 5: [(6, 2), (1, 1), (2, 1)],
}
ITEM_RECS = {
    1: [(1, 2), (5, 2), (2, 1)], 2: [(3, 2), (1, 1), (2, 1)], 3: [(2, 2), (1, 1), (3, 1)],
    4: [(1, 1), (3, 1), (4, 1)], 5: [(1, 1), (2, 1), (3, 1)],
}
HYBRID_RECS = {
    1: [(1, 2), (2, 2), (3, 1)], 2: [(1, 2), (3, 2), (2, 1)], 3: [(1, 2), (2, 2), (3, 2)],
    4: [(1, 2), (2, 1), (3, 1)], 5: [(1, 2), (2, 2), (3, 1)],
}
MO_RECS = {
    1: [(1, 2), (3, 2), (6, 2)], 2: [(3, 2), (1, 1), (4, 1)], 3: [(1, 1), (2, 1), (3, 1)],
    4: [(6, 2), (1, 1), (2, 1)], 5: [(6, 2), (1, 1), (2, 1)],
}

# Pareto neighbours for TRAIN and SECOND by (n, missing)
PARETO = {
    (2, "shared"): {1: {2, 4, 5}, 2: {1, 5}, 3: {4, 5}, 4: {2, 3, 5}, 5: {2, 4}},
    (2, "zero"): {1: {2, 3, 4}, 2: {1, 5}, 3: {1, 4, 5}, 4: {1, 2, 3, 5}, 5: {2, 4}},
    (3, "shared"): {1: {2, 4, 5}, 2: {1, 4, 5}, 3: {2, 4, 5}, 4: {2, 3, 5}, 5: {2, 3, 4}},
    (3, "zero"): {1: {2, 3, 4}, 2: {1, 4, 5}, 3: {1, 4, 5}, 4: {1, 2, 3, 5}, 5: {2, 3, 4}},
}

# tp, fp, tn, fn, precision, recall, f1
METRICS = {
    "user": (6, 9, 0, 3, 0.4, 0.666667, 0.5),
    "item": (6, 9, 0, 3, 0.4, 0.666667, 0.5),
    "hybrid": (6, 9, 0, 3, 0.4, 0.666667, 0.5),
    "mo": (7, 8, 0, 2, 0.466667, 0.777778, 0.583333),
}


def pairs(wide):
    return [(u, i) for u, items in wide.items() for i in items]
