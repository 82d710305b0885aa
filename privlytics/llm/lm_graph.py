"""The steps of ``lm_score`` that take most of its time, as graphs for onnxruntime: gradients of a batch, and scores of windows.

They compute what ``gradients`` and ``log10_of`` do there in numpy, on one thread, with faster kernels. A graph is written as
bytes of the public ONNX format (``model``: its messages, field by field), so nothing but the runtime is needed. Without it,
all is done in numpy: the same results but for rounding, in more time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

FLOAT, INT32, INT64 = 1, 6, 7
_KINDS = {"float32": FLOAT, "int32": INT32, "int64": INT64}
Run = Callable[[dict[str, np.ndarray]], list[np.ndarray]]


def _number(n: int) -> bytes:
    out, n = bytearray(), n & (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(at: int, value: int | str | bytes) -> bytes:
    if isinstance(value, int):
        return _number(at << 3) + _number(value)
    raw = value.encode() if isinstance(value, str) else value
    return _number(at << 3 | 2) + _number(len(raw)) + raw


def _tensor(name: str, a: np.ndarray) -> bytes:
    return b"".join(_field(1, n) for n in a.shape) + _field(2, _KINDS[a.dtype.name]) + _field(8, name) + _field(9, np.ascontiguousarray(a).tobytes())


def _value(name: str, kind: int, rank: int) -> bytes:
    shape = b"".join(_field(1, _field(2, f"{name}{i}")) for i in range(rank))
    return _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, shape)))


def _attribute(name: str, value: int | str | list[int]) -> bytes:
    if isinstance(value, str):
        return _field(1, name) + _field(4, value) + _field(20, 3)
    if isinstance(value, int):
        return _field(1, name) + _field(3, value) + _field(20, 2)
    return _field(1, name) + b"".join(_field(8, n) for n in value) + _field(20, 7)


class Graph:
    """Nodes in order. ``add`` gives the name of a node's result; arrays become constants."""

    def __init__(self):
        self.nodes: list[bytes] = []
        self.constants: list[bytes] = []
        self.inputs: list[bytes] = []

    def input(self, name: str, kind: int, rank: int) -> str:
        self.inputs.append(_value(name, kind, rank))
        return name

    def constant(self, a: np.ndarray | list[int]) -> str:
        name = f"c{len(self.constants)}"
        self.constants.append(_tensor(name, np.asarray(a, None if isinstance(a, np.ndarray) else np.int64)))
        return name

    def add(self, kind: str, *of: str, **attributes: int | str | list[int]) -> str:
        name = f"n{len(self.nodes)}"
        self.nodes.append(b"".join(_field(1, x) for x in of) + _field(2, name) + _field(4, kind) + b"".join(_field(5, _attribute(k, v)) for k, v in attributes.items()))
        return name

    def model(self, outputs: dict[str, int]) -> bytes:
        """The whole; ``outputs``: ranks by name."""
        graph = b"".join([_field(1, n) for n in self.nodes] + [_field(2, "lm")] + [_field(5, c) for c in self.constants])
        graph += b"".join(_field(11, i) for i in self.inputs) + b"".join(_field(12, _value(n, FLOAT, rank)) for n, rank in outputs.items())
        return _field(1, 8) + _field(7, graph) + _field(8, _field(1, "") + _field(2, 18))


def _attend(g: Graph, x: str, opens: str, qk: str, vo: str, mask: np.ndarray) -> tuple[str, ...]:
    """Masked attention of the second half of each window, as in ``lm_score.forward``; projections come multiplied out, as q k' and v o.

    ``opens``: 1 for windows whose first half is before the text, else 0. (late inputs, turned inputs, compared, attention, mixed, result)
    """
    half = mask.shape[0]
    late = g.add("Slice", x, g.constant([half]), g.constant([2 * half]), g.constant([1]))
    turned = g.add("Transpose", x, perm=[0, 2, 1])
    q = g.add("MatMul", late, qk)
    closed = mask.copy()
    closed[:, :half] = mask.min()
    s = g.add("Add", g.add("MatMul", q, turned), g.add("Gather", g.constant(np.stack([mask, closed])), opens))
    a = g.add("Softmax", s, axis=-1)
    c = g.add("MatMul", a, x)
    return late, turned, q, a, c, g.add("Add", g.add("MatMul", c, vo), late)


def scoring(t: dict[str, np.ndarray], mask: np.ndarray) -> bytes:
    """(ids, opens, classes, goal) to natural logarithms of p(goal). ``t``: embeddings x, pos, qk, vo, u, last."""
    g = Graph()
    ids, opens, classes, goal = g.input("ids", INT32, 2), g.input("opens", INT64, 1), g.input("classes", INT64, 1), g.input("goal", INT64, 2)
    x = g.add("Add", g.add("Gather", g.constant(t["x"]), ids), g.constant(t["pos"]))
    h = _attend(g, x, opens, g.constant(t["qk"]), g.constant(t["vo"]), mask)[-1]
    line = g.add("Reshape", h, g.constant([-1, t["u"].shape[0]]))
    z = g.add("Gemm", line, g.constant(t["u"]), g.add("Gather", g.constant(t["last"]), classes))
    return g.model({g.add("GatherElements", g.add("LogSoftmax", z, axis=-1), goal, axis=-1): 2})


def training(last: np.ndarray, mask: np.ndarray, dim: int) -> bytes:
    """Gradients of a batch: of its ids' embeddings, of emb, pos, q k', v o and u.

    From ``rows``: embeddings of the distinct ids, ``kinds``: their classes, ``place``: the ids of the windows among them, ``opens``,
    ``classes``: of the inputs before the targets, ``goal``: of the targets, ``each``: weights of the targets, ``dim`` times, and the weights.
    """
    g = Graph()
    rows, kinds, place, opens = g.input("rows", FLOAT, 2), g.input("kinds", INT64, 2), g.input("place", INT64, 2), g.input("opens", INT64, 1)
    classes, goal, each = g.input("classes", INT64, 1), g.input("goal", INT64, 2), g.input("each", FLOAT, 2)
    pos, qk, vo, u = (g.input(n, FLOAT, 2) for n in ("pos", "qk", "vo", "u"))
    half = mask.shape[0]
    flat, wide = g.constant([-1, dim]), g.constant([-1, half, dim])
    x = g.add("Add", g.add("Gather", rows, place), pos)
    late, turned, q, a, c, h = _attend(g, x, opens, qk, vo, mask)
    line = g.add("Reshape", h, flat)
    p = g.add("Softmax", g.add("Gemm", line, u, g.add("Gather", g.constant(last), classes)), axis=-1)
    # 1 is taken off before the sums: where p is near 1, Adam moves by what is left
    p = g.add("ScatterElements", p, goal, g.add("Sub", g.add("GatherElements", p, goal, axis=-1), g.constant(np.ones((1, 1), np.float32))), axis=-1)
    du = g.add("Gemm", g.add("Mul", line, each), p, transA=1)
    dh = g.add("Mul", g.add("Gemm", p, u, transB=1), each)
    mixed = g.add("Reshape", g.add("Gemm", dh, vo, transB=1), wide)
    dvo = g.add("Gemm", g.add("Reshape", c, flat), dh, transA=1)
    mean = g.add("MatMul", g.add("Mul", c, mixed), g.constant(np.ones((dim, 2 * half), np.float32)))
    ds = g.add("Mul", g.add("Sub", g.add("MatMul", mixed, turned), mean), a)
    dq = g.add("Reshape", g.add("MatMul", ds, x), flat)
    dqk = g.add("Gemm", g.add("Reshape", late, flat), dq, transA=1)
    dlate = g.add("Reshape", g.add("Gemm", dq, qk, dh, transB=1), wide)
    dx = g.add("MatMul", g.add("Transpose", g.add("Concat", a, ds, axis=1), perm=[0, 2, 1]), g.add("Concat", mixed, q, axis=1))
    dx = g.add("Add", dx, g.add("Pad", dlate, g.constant([0, half, 0, 0, 0, 0])))
    none = g.add("ConstantOfShape", g.add("Shape", rows))
    drows = g.add("ScatterND", none, g.add("Reshape", place, g.constant([-1, 1])), g.add("Reshape", dx, flat), reduction="add")
    demb = g.add("ScatterND", g.constant(np.zeros((last.shape[0], dim), np.float32)), kinds, drows, reduction="add")
    return g.model({drows: 2, demb: 2, g.add("ReduceSum", dx, g.constant([0]), keepdims=0): 2, dqk: 2, dvo: 2, du: 2})


def load(model: bytes) -> Run | None:
    """What runs the graph on one thread; none without the runtime."""
    try:
        import onnxruntime
    except ImportError:
        return None
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    options.log_severity_level = 3
    session = onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"])
    return lambda feeds: session.run(None, feeds)
