"""Budget assembly against a step-by-step simulation of the generation
loop's stopping rules over collected step records (test-only Python)."""

from collections import defaultdict

from tracekit.operators import budget as B
from tracekit.sources import fixtures as X

from .conftest import SF_SMALL


def _simulate(steps, mode, num_waits, max_len, margin=400):
    by_sample = defaultdict(dict)
    for r in steps:
        by_sample[r.sample_id][r.step] = r
    out = {}
    for sid, recs in by_sample.items():
        text, tokens, trunc, stopped, last = "", 0, False, False, None
        for k in range(num_waits + 1):
            if k not in recs:
                break
            r = recs[k]
            text += r.gen_text
            tokens += r.gen_tokens
            last = k
            stop = False
            if r.finish_reason == "length" or tokens >= max_len:
                trunc, stop = True, True
            elif tokens > max_len - margin:
                stop = True
            if not stop and (k == num_waits or mode == "none"):
                stop = True
            if stop:
                stopped = True
                break
            marker = "Alternatively" if mode == "alternating" and k % 2 == 1 else "Wait"
            text += f"\n{marker}\n"
        out[sid] = (last, trunc, stopped, tokens, text)
    return out


def test_assemble_matches_simulation(spark):
    steps_df = X.gen_steps(spark, SF_SMALL)
    steps = steps_df.collect()
    for mode, waits, max_len in [("budget", 3, 1500), ("alternating", 5, 2500), ("none", 3, 1500),
                                 ("budget", 1, 600)]:
        want = _simulate(steps, mode, waits, max_len)
        got = {r.sample_id: (r.steps, r.truncated, r.stopped, r.tokens, r.response)
               for r in B.assemble_budget(steps_df, mode, waits, max_len).collect()}
        assert got == want, mode
        nxt = {r.sample_id: r.next_step for r in B.next_round(
            B.assemble_budget(steps_df, mode, waits, max_len)).collect()}
        assert nxt == {s: v[0] + 1 for s, v in want.items() if not v[2]}
