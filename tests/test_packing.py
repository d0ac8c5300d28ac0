"""The span packers against step-by-step packing of real strings."""

import random

from chunkloom.functions.packing import pack_chars, pack_sentences


def packed_strings(segments, size, overlap):
    done, run = [], None
    for s in segments:
        if run is None:
            run = s
        elif len(run) + len(s) > size:
            done.append(run)
            run = f"{run[len(run) - overlap:]} {s}" if 0 < overlap < len(run) else s
        else:
            run = f"{run} {s}"
    return done + ([run] if run is not None else [])


def test_pack_chars_equals_string_packing():
    rng = random.Random(3)
    for _ in range(300):
        size = rng.choice([5, 10, 40])
        overlap = rng.randint(0, size // 2)
        segments = ["".join(rng.choice("abc") for _ in range(rng.randint(1, size + 5))) for _ in range(rng.randint(0, 30))]
        joined = " ".join(segments)
        spans = pack_chars([len(s) for s in segments], [], size, overlap)
        assert [joined[a:a + n] for a, n in spans] == packed_strings(segments, size, overlap)


def test_pack_sentences_equals_list_packing():
    rng = random.Random(4)
    for _ in range(300):
        size, keep = rng.choice([5, 10, 40]), rng.randint(0, 3)
        segments = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 30))]
        want, group = [], []
        for s in segments:
            if group and len("".join(group)) + len(s) > size:
                want.append("".join(group))
                group = group[len(group) - min(keep, len(group)):]
            group.append(s)
        want += ["".join(group)] if group else []
        joined = "".join(segments)
        assert [joined[a:a + n] for a, n in pack_sentences([len(s) for s in segments], size, keep)] == want


def test_long_segments_are_cut_by_windows_between_packed_runs():
    text = "ab cd " + "x" * 25 + " ef"
    spans = pack_chars([2, 2, 25, 2], [[25]], 10, 2)
    assert [text[a:a + n] for a, n in spans] == ["ab cd", "x" * 10, "x" * 10, "x" * 9, "ef"]


def test_window_cuts_at_the_last_space_past_half():
    text = "aaaa bbbb cccc dddd"
    spans = pack_chars([len(text)], [[4, 4, 4, 4]], 12, 0)
    assert [text[a:a + n].strip() for a, n in spans] == ["aaaa bbbb", "cccc dddd"]
