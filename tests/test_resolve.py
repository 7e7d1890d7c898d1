"""The rules that resolve links, against plain loops over all notes."""

import random
import unicodedata

from evidencelake.operators.resolve import cascade


def folded(x):
    return "".join(c for c in unicodedata.normalize("NFD", x.lower()) if unicodedata.category(c)[0] != "M")


def parts(path):
    out = []
    for p in folded(path).split("/"):
        if p == "..":
            if not out:
                return None
            out.pop()
        elif p not in ("", "."):
            out.append(p)
    return out or None


def brute(src, target, files):
    if "." not in target.split("/")[-1]:
        target += ".md"
    near, whole = parts("/".join([*src.split("/")[:-1], target])), parts(target.lstrip("/"))
    tries = [("folder", [f for f in files if near and parts(f) == near]), ("path", [f for f in files if whole and parts(f) == whole]), ("suffix", [f for f in files if whole and parts(f)[-len(whole) :] == whole])]
    for rule, found in tries:
        if found:
            return rule, found[0] if len(found) == 1 else None, len(found), sorted(found)[:10] if len(found) > 1 else None, "resolved" if len(found) == 1 else "ambiguous"
    return None, None, 0, None, "missing"


def test_rules_against_plain_loops(spark):
    rng = random.Random(7)
    names = ["boat", "Harbor", "índex", "keel", "index"]
    files = sorted({"/".join([*(rng.choice(["a", "B", "c"]) for _ in range(rng.randint(0, 3))), f"{rng.choice(names)}.md"]) for _ in range(60)} | {f"d{k}/index.md" for k in range(15)})
    ups = ["", "", "../", "./", "../../", "/"]
    targets = [rng.choice(ups) + "/".join([*(rng.choice(["a", "b", "C"]) for _ in range(rng.randint(0, 2))), rng.choice([*names, "boat.md", "gone", "x.png"])]) for _ in range(150)]
    links = [(rng.choice(files), t, k) for k, t in enumerate(targets)] + [("boat.md", "../boat", 1000), ("a/boat.md", "", 1001), ("a/boat.md", "..", 1002)]
    got = cascade(spark.createDataFrame(links, "src string, target string, n_line int"), spark.createDataFrame([(f,) for f in files], "path string"))
    found = {r.n_line: (r.rule, r.dst, r.n, r.candidates, r.reason) for r in got.collect()}
    assert len(found) == len(links)
    for src, target, k in links:
        want = brute(src, target, files)
        assert found[k] == want, (src, target, found[k], want)
    assert {r[4] for r in found.values()} == {"resolved", "ambiguous", "missing"} and {r[0] for r in found.values()} == {"folder", "path", "suffix", None}
