"""Trains the block labeller: ``python -m inkgrove.llm.blocks_train FOLDER [OUT]``.

Most of the training set are invented documents whose labels are known by construction (``block_variants``), around
plain lines of real text; beside them stand real rows (a bounded sample, ``SAMPLE_ROWS`` per column, the first in order of
a hash of the id) with the labels of the exact grammar as weak supervision. Thresholds and the report come from a fifth
of the invented documents that is held out, so no grammar has a say in them. Gradients are written out by hand; the
optimiser is Adam.
"""

from __future__ import annotations

import sys
from zlib import crc32

import numpy as np

from inkgrove.llm import blocks as B
from inkgrove.llm.block_variants import compose
from inkgrove.llm.residue import MD_LIST, WIKI_HEADING, quiet_spans, residue

SAMPLE_ROWS, INVENTED, HIDDEN, EPOCHS, BATCH, RATE = 3000, 12_000, 40, 7, 64, 0.01
#: A threshold leaves at most this share of the held-out lines with residue unflagged, and is never above ``HIGHEST``: a
#: flag too many is looked at once more, a flag too few is not.
MISSED, HIGHEST = 0.002, 0.2


def targets(text: str, doc: list[B.Leaf]) -> tuple[np.ndarray, np.ndarray]:
    """Label and residue kinds of each leaf."""
    label, kinds = np.zeros(len(doc), np.int64), np.zeros((len(doc), len(B.KINDS)), np.float32)
    quiet, found = quiet_spans(text), residue(text, True)
    for k, leaf in enumerate(doc):
        inside = [s for a, b, s in quiet if a <= leaf.start and b >= leaf.end]
        if "front" in leaf.path:
            label[k] = 6
        elif "fence" in inside or "fence" in leaf.path:
            label[k] = 3
        elif "formula" in inside or "math" in leaf.path:
            label[k] = 4
        elif any(p[0] == "h" and p[1:].isdigit() for p in leaf.path) or WIKI_HEADING.match(leaf.text) or leaf.text.startswith(("\\section", "\\subsection")) or leaf.text[:3].lower() in ("<h1", "<h2", "<h3", "<h4", "<h5", "<h6"):
            label[k] = 1
        elif MD_LIST.match(leaf.text) or "<li" in leaf.path or leaf.text.lstrip().startswith("\\item"):
            label[k] = 2
        elif "row" in leaf.path or "{|" in leaf.path or "<table" in leaf.path or "\\tabular" in leaf.path:
            label[k] = 5
        for a, b, kind in found:
            if a < leaf.end and b > leaf.start:
                kinds[k, B.KINDS.index(kind)] = 1
    return label, kinds


def _backward(p: dict, d: str, x: np.ndarray, valid: np.ndarray, grad_h: np.ndarray, flat_rows: np.ndarray) -> dict[str, np.ndarray]:
    """Backpropagation through time of one direction, from gradients of its hidden states."""
    b, t, _ = x.shape
    wh = p["wh_" + d]
    n = wh.shape[0]
    steps = list(range(t)) if d == "f" else list(range(t - 1, -1, -1))
    h, c = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32)
    tape = []
    for k in steps:
        z = x[:, k] + h @ wh
        s, g = B._sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
        new_c = s[:, n : 2 * n] * c + s[:, :n] * g
        tanh_c = np.tanh(new_c)
        v = valid[:, k, None]
        tape.append((h, c, s, g, tanh_c, v))
        c, h = np.where(v, new_c, c), np.where(v, s[:, 2 * n :] * tanh_c, h)
    dz_all = np.zeros_like(x)
    dwh = np.zeros_like(wh)
    dh, dc = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32)
    for k, (h0, c0, s, g, tanh_c, v) in zip(reversed(steps), reversed(tape), strict=True):
        dh_new = np.where(v, dh + grad_h[:, k], 0)
        dc_new = np.where(v, dc, 0) + dh_new * s[:, 2 * n :] * (1 - tanh_c**2)
        i, f, o = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :]
        dz = np.concatenate([dc_new * g * i * (1 - i), dc_new * c0 * f * (1 - f), dh_new * tanh_c * o * (1 - o), dc_new * i * (1 - g**2)], axis=1)
        dz_all[:, k] = dz
        dwh += h0.T @ dz
        dh = np.where(v, dz @ wh.T, dh + grad_h[:, k])
        dc = np.where(v, dc_new * f, dc)
    dz = dz_all[valid]
    return {"wx_" + d: flat_rows.T @ dz, "wh_" + d: dwh, "b_" + d: dz.sum(axis=0)}


def _loss_and_grads(model: B.Labeller, group: list[list[B.Leaf]], label: np.ndarray, kinds: np.ndarray) -> tuple[float, dict]:
    p = model.params
    sizes = np.array([len(d) for d in group])
    valid = np.arange(sizes.max())[None, :] < sizes[:, None]
    flat = B.dense(B.features(group))
    x, h = {}, {}
    for d in "fb":
        x[d] = np.zeros((*valid.shape, p["b_" + d].size), np.float32)
        x[d][valid] = flat @ p["wx_" + d] + p["b_" + d]
        h[d] = model._direction(x[d], valid, d)
    hidden = np.concatenate([h["f"][valid], h["b"][valid]], axis=1)
    z = hidden @ p["wo"] + p["bo"]
    k = len(B.LABELS)
    e = np.exp(z[:, :k] - z[:, :k].max(axis=1, keepdims=True))
    e /= e.sum(axis=1, keepdims=True)
    q = B._sigmoid(z[:, k:])
    weight = np.where(kinds > 0, 4.0, 1.0)
    loss = -np.log(e[np.arange(len(label)), label] + 1e-9).mean() - (weight * np.log(np.where(kinds > 0, q, 1 - q) + 1e-9)).mean()
    dz = np.empty_like(z)
    dz[:, :k] = e
    dz[np.arange(len(label)), label] -= 1
    dz[:, k:] = weight * (q - kinds)
    dz /= len(label)
    grads = {"wo": hidden.T @ dz, "bo": dz.sum(axis=0)}
    dhidden = dz @ p["wo"].T
    n = dhidden.shape[1] // 2
    for d, part in (("f", dhidden[:, :n]), ("b", dhidden[:, n:])):
        grad_h = np.zeros((*valid.shape, n), np.float32)
        grad_h[valid] = part
        grads |= _backward(p, d, x[d], valid, grad_h, flat)
    return float(loss), grads


def initial(seed: int = 1) -> B.Labeller:
    rng = np.random.default_rng(seed)
    out = len(B.LABELS) + len(B.KINDS)
    p = {}
    for d in "fb":
        p["wx_" + d] = rng.normal(0, 0.15, (B.DIM, 4 * HIDDEN))
        p["wh_" + d] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
        p["b_" + d] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    p["wo"], p["bo"] = rng.normal(0, 0.2, (2 * HIDDEN, out)), np.concatenate([np.zeros(len(B.LABELS)), np.full(len(B.KINDS), -3.0)])
    return B.Labeller({k: v.astype(np.float32) for k, v in p.items()}, np.full(len(B.KINDS), 0.5, np.float32))


Row = tuple[list[B.Leaf], np.ndarray, np.ndarray]


def weak(texts: list[str]) -> list[Row]:
    """Rows labelled by the grammar."""
    docs = [B.leaves(t) for t in texts]
    return [(d, *targets(t, d)) for t, d in zip(texts, docs, strict=True) if d]


def invented(prose: list[str], n: int, seed: int = 3) -> list[Row]:
    """Rows labelled by construction."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        text, labels, kinds = compose(rng, prose)
        doc = B.leaves(text)
        if doc:
            out.append((doc, np.array([B.LABELS.index(labels[x.line]) for x in doc]), np.array([[k in kinds[x.line] for k in B.KINDS] for x in doc], np.float32)))
    return out


def rates(model: B.Labeller, rows: list[Row]) -> dict:
    """The network alone, by rows and lines: precision and recall of residue at its thresholds, accuracy of labels."""
    scores = model.scores([d for d, _, _ in rows])
    hit = [(s[:, len(B.LABELS) :] >= model.thresholds) for s in scores]
    mine, true = np.array([h.any() for h in hit]), np.array([k.any() for *_, k in rows])
    flat, want = np.concatenate(hit), np.concatenate([k for *_, k in rows]) > 0
    right = np.concatenate([s[:, : len(B.LABELS)].argmax(axis=1) == label for s, (_, label, _) in zip(scores, rows, strict=True)])
    return {
        "rows": len(rows), "row_precision": float((mine & true).sum() / max(1, mine.sum())), "row_recall": float((mine & true).sum() / max(1, true.sum())),
        "line_precision": float((flat & want).sum() / max(1, flat.sum())), "line_recall": float((flat & want).sum() / max(1, want.sum())), "label_accuracy": float(right.mean()),
    }


def train(texts: list[str], epochs: int = EPOCHS, seed: int = 1, say=lambda *_: None, made: list[Row] | None = None) -> tuple[B.Labeller, dict]:
    """Fits on four fifths of the invented rows and on the texts; thresholds and the report come from the last fifth.
    Without invented rows the texts are divided like that."""
    data = weak(texts)
    held, used = (made[::5], [x for k, x in enumerate(made) if k % 5] + data) if made else (data[::5], [x for k, x in enumerate(data) if k % 5])
    model, rng = initial(seed), np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in model.params.items()}
    square = {k: np.zeros_like(v) for k, v in model.params.items()}
    step = 0
    for epoch in range(epochs):
        order = sorted(rng.permutation(len(used)), key=lambda k: len(used[k][0]) // 4)
        batches = [order[a : a + BATCH] for a in range(0, len(order), BATCH)]
        total = 0.0
        for b in rng.permutation(len(batches)):
            group = [used[k] for k in batches[b]]
            loss, grads = _loss_and_grads(model, [g[0] for g in group], np.concatenate([g[1] for g in group]), np.concatenate([g[2] for g in group]))
            total += loss
            step += 1
            rate = RATE * 0.1 ** (epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 2.0 / (norm + 1e-9))
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.001 * (g * g - square[k])
                model.params[k] -= (rate * mean[k] / (np.sqrt(square[k]) + 1e-8)).astype(np.float32)
        say(f"epoch {epoch}: loss {total / len(batches):.4f}")
    q = np.concatenate([x[:, len(B.LABELS) :] for x in model.scores([d for d, _, _ in held])])
    kinds = np.concatenate([x[2] for x in held])
    for k in range(len(B.KINDS)):
        mine = q[kinds[:, k] > 0, k]
        model.thresholds[k] = min(HIGHEST, np.quantile(mine, MISSED)) if len(mine) else HIGHEST
    report = rates(model, held)
    return model, report | {"residue_recall": report["line_recall"], "thresholds": model.thresholds.tolist()}


def main(folder: str, out: str = B.WEIGHTS) -> None:
    import pyarrow.parquet as pq

    texts, rest = [], []
    for name, column in (("chunks", "chunk_text"), ("notes", "summary")):
        t = pq.read_table(f"{folder}/{name}.parquet", columns=["id", column])
        rows = sorted(zip(t.column("id").to_pylist(), t.column(column).to_pylist(), strict=True), key=lambda r: crc32(str(r[0]).encode()))
        texts += [x for _, x in rows[:SAMPLE_ROWS] if x]
        rest += [x for _, x in rows[SAMPLE_ROWS:] if x]
    prose = sorted({line.strip() for x in texts for line in x.split("\n") if len(line.split()) > 2 and len(line) < 400 and not B._MARKS.search(line)})
    made = invented(prose, INVENTED)
    say = lambda *a: print(*a, flush=True)
    say(f"{len(prose)} plain lines, {len(made)} invented documents, {len(texts)} real rows")
    model, report = train(texts, say=say, made=made)
    say("invented, held out:", report)
    say("real rows not trained on, against the grammar:", rates(model, weak(rest)))
    model.save(out)


if __name__ == "__main__":
    main(*sys.argv[1:])
