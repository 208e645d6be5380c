"""Music-theory expressions: pitches, chords, keys, spelling."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed names: pitch classes with sharps, letters to pitch classes, and chord qualities by the third and fifth they hold.
SHARPS = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
LETTERS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
MAJOR = ["", "maj", "7", "maj7", "6", "9", "maj9", "11", "maj11", "13", "maj13", "maj6", "add9"]
MINOR = ["min", "min7", "minmaj7", "min6", "min9", "min11", "min13"]
#: Fixed interval steps of scales.
SCALES = {
    "major": [2, 2, 1, 2, 2, 2, 1],
    "minor": [2, 1, 2, 2, 1, 2, 2],
    "dorian": [2, 1, 2, 2, 2, 1, 2],
    "phrygian": [1, 2, 2, 2, 1, 2, 2],
    "lydian": [2, 2, 2, 1, 2, 2, 1],
    "mixolydian": [2, 2, 1, 2, 2, 1, 2],
    "locrian": [1, 2, 2, 1, 2, 2, 2],
    "harmonicMinor": [2, 1, 2, 2, 1, 3, 1],
    "phrygianDominant": [1, 3, 1, 2, 1, 2, 2],
}


def _map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(pairs.items())))


def pitch_class(name: Column) -> Column:
    """0 to 11 of a name like C#, Bb or E; null where it is none."""
    base = _map(LETTERS)[F.substring(name, 1, 1)]
    shift = F.length(F.regexp_replace(name, "[^#]", "")) - F.length(F.regexp_replace(F.substring(name, 2, 9), "[^b]", ""))
    return F.when(name.rlike(r"^[A-G](#{0,3}|b{0,3})$"), F.pmod(base + shift, F.lit(12)))


def pitch_name(pc: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in SHARPS)), F.pmod(pc, F.lit(12)).cast("int") + 1)


def chord_class(chord: Column) -> Column:
    """0-11 major, 12-23 minor, 24 no chord, -1 where the quality holds neither triad; null where it is no chord."""
    head = F.regexp_replace(chord, r"/.*$", "")
    root = pitch_class(F.substring_index(head, ":", 1))
    quality = F.when(head.contains(":"), F.regexp_replace(F.substring_index(head, ":", -1), r"\(.*\)$", "")).otherwise("")
    return (
        F.when(chord == "N", 24)
        .when(root.isNull(), F.lit(None).cast("int"))
        .when(quality.isin(MAJOR), root)
        .when(quality.isin(MINOR), root + 12)
        .otherwise(-1)
    )


def chord_name(index: Column) -> Column:
    """The inverse: C:maj ... B:min, N for 24, X below 0; other numbers raise."""
    return (
        F.when(index < 0, "X")
        .when(index == 24, "N")
        .when(index < 12, F.concat(pitch_name(index), F.lit(":maj")))
        .when(index < 24, F.concat(pitch_name(index - 12), F.lit(":min")))
        .otherwise(F.raise_error(F.lit("a chord index is 0 to 24")))
    )


def f0_to_midi(f: Column) -> Column:
    """-1 for unvoiced, else rint(69 + 12 log2(f / 440)) within 0..127."""
    return F.when(f <= 0, F.lit(-1)).otherwise(F.least(F.greatest(F.rint(69 + 12 * F.log2(f / 440)), F.lit(0.0)), F.lit(127.0)).cast("int"))


def note_to_midi(pc: Column, octave: Column, base: int = 5) -> Column:
    return F.least(F.greatest(pc + (octave + base) * 12, F.lit(0)), F.lit(127)).cast("int")


def staff_letter(morphetic: Column) -> Column:
    """Letter of a morphetic number; 60 is C."""
    return F.element_at(F.array(*(F.lit(x) for x in "CDEFGAB")), F.pmod(morphetic - 60, F.lit(7)).cast("int") + 1)


def staff_octave(morphetic: Column) -> Column:
    return (F.floor((morphetic - 60) / 7) + 4).cast("int")


def scale_degree(degree: Column, accidental: Column, octave: Column, tonic: Column, scale: Column) -> tuple[Column, Column]:
    """(pitch class, octave) of a scale degree from 1 in a key; the scale must be known."""
    steps = F.create_map(*chain.from_iterable((F.lit(k), F.array(*(F.lit(x) for x in v))) for k, v in SCALES.items()))[scale]
    pitch = octave * 12 + tonic + F.aggregate(F.slice(steps, F.lit(1), (degree - 1).cast("int")), F.lit(0), lambda s, x: s + x) + accidental
    return F.pmod(pitch, F.lit(12)).cast("int"), F.floor(pitch / 12).cast("int")


def key_score(estimated: Column, reference: Column) -> Column:
    """Weighted key agreement over 24 classes (0-11 major, 12-23 minor): same 1, fifth .5, relative .3, parallel .2."""
    e, r = F.pmod(estimated, F.lit(12)), F.pmod(reference, F.lit(12))
    same_mode = (estimated < 12) == (reference < 12)
    return (
        F.when(estimated == reference, 1.0)
        .when(same_mode & (F.pmod(e - r, F.lit(12)) == 7), 0.5)
        .when(~same_mode & (reference < 12) & (F.pmod(e - r, F.lit(12)) == 9), 0.3)
        .when(~same_mode & (reference >= 12) & (F.pmod(e - r, F.lit(12)) == 3), 0.3)
        .when(~same_mode & (e == r), 0.2)
        .otherwise(0.0)
    )


def bars_to_seconds(first: Column, last: Column, times: Column) -> tuple[Column, Column]:
    """Seconds of a 1-based inclusive bar range, from bar times with an end-of-file entry; nulls out of range."""
    ok = (first >= 1) & (last >= first) & (last < F.size(times))
    return F.when(ok, F.get(times, first - 1)), F.when(ok, F.get(times, last))


def times_to_frames(times: Column, fps: float, length: Column) -> Column:
    """rint(t * fps) within [0, length), distinct and sorted."""
    frames = F.transform(times, lambda t: F.rint(t * fps).cast("int"))
    return F.sort_array(F.array_distinct(F.filter(frames, lambda i: (i >= 0) & (i < length))))


def frames_to_times(frames: Column, fps: float) -> Column:
    return F.transform(F.sort_array(F.array_distinct(frames)), lambda i: i / fps)


def multi_hot(tags: Column, vocabulary: list[str]) -> Column:
    return F.transform(F.array(*(F.lit(v) for v in vocabulary)), lambda t: F.coalesce(F.array_contains(tags, t), F.lit(False)).cast("int"))


def chord_of(degree: int, size: int, tonic: int, scale: list[int], suspensions=(), adds=(), omits=(), alterations=(), borrowed=None, applied: int = 0) -> tuple[int, tuple[int, ...]]:
    """(root pitch class, semitone steps upwards) of a chord in a key, in root position.

    size: 5, 7, 9, ... takes every other degree up to it. The first suspension takes the place of the third; adds of 4
    and 6 mean 11 and 13; omits drop the third or fifth; alterations are like "b9" or "#5". borrowed: another scale,
    by name, or its seven offsets. applied: the chord of that degree in the major key of `degree`."""
    wanted = set(range(1, size + 1, 2))
    for k, d in enumerate(suspensions):
        if (k == 0 and 3 not in wanted) or d in wanted:
            raise ValueError("a suspension does not fit")
        wanted = (wanted - {3} if k == 0 else wanted) | {d}
    wanted |= {d + 7 if d in (4, 6) else d for d in adds}
    if not set(omits) <= (wanted & {3, 5}):
        raise ValueError("an omitted degree is not there")
    wanted -= set(omits)
    moved = {int(x[1:]): -1 if x[0] == "b" else 1 for x in alterations}
    wanted |= set(moved)

    def offsets(steps: list[int]) -> list[int]:
        return [sum(steps[:k]) for k in range(7)]

    ladder = list(borrowed) if isinstance(borrowed, list) else offsets(SCALES.get(borrowed, scale))
    root, base = degree, tonic
    if applied > 0:
        root, base, ladder = applied, (tonic + ladder[degree - 1]) % 12, offsets(SCALES["major"])

    def height(d: int) -> int:
        octave, step = divmod(root + d - 2, 7)
        return ladder[step] + 12 * octave - (1 if d == 7 and applied == 7 else 0) + moved.get(d, 0)

    pitches = [base + height(d) for d in sorted(wanted)]
    return pitches[0] % 12, tuple(b - a for a, b in zip(pitches, pitches[1:], strict=False))
