"""A made code base: one source file for each row of ``part``.

The language goes by key (five in turn), the numbers by the row.  A file is a
head and ``p_size % 4`` blocks of one shape, so lines move with the data.  In
the shapes {K} is the row's key, {N} the key of the next file of its language,
{D} that file's directory, {S} the part's size and {I} the block's number.
Each import names the next file, so the import graph is made of chains.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIRS, BLOCKS = 7, 4


@dataclass(frozen=True)
class Shape:
    ending: str
    lang: str
    head: str
    block: str


SHAPES = (
    Shape(".ts", "typescript", '''import { moor{N}_0 } from "../d{D}/part_{N}";

const DRAFT_{K} = {S};
const BEAM_{K} = {S} * 2;

// Holds ships of size {S}.
export abstract class Dock{K} extends Quay {
  readonly berths = {S};

  assign(ship: Ship): boolean {
    return pickBerth(this.berths, ship);
  }
}

''', '''export function moor{K}_{I}(
  line: Rope,
): number {
  checkTide(line);
  return [line].map(tieKnot).length / /[{`]\\/'/.source.length;
}

'''),
    Shape(".py", "python", '''import tides.d{D} as tide
from harbour.part_{N} import haul


class _Buoy{K}(Float):
    """Floats at {S}."""

    @anchored({S})
    def drift(wind, *, slack={S}):
        return swing_round(wind, slack)


''', '''async def haul_{K}_{I}(crew):
    # pull together
    for hand in crew:
        print(count_rope(hand))


'''),
    Shape(".go", "go", '''package harbour

import tide "shore/d{D}"

// Crane lifts {S} tons.
type Crane{K} struct {
	reach int
}

func (c *Crane{K}) Lift(load int) (int, error) {
	return swingArm(c.reach, load), nil
}

var spare{K} = {S}

''', '''func winch{K}_{I}(rope []string) {
	for _, r := range rope {
		pullIn(r, len(rope))
	}
}

'''),
    Shape(".rs", "rust", '''use shore::d{D}::tide;

/// Keeps {S} boats.
/// Not more.
pub struct Marina{K} {
    pub slips: u32,
}

impl Marina{K} {
    pub(crate) fn rent(&self, boat: &'static str) -> u32 {
        assert!(self.slips > count_hulls(boat));
        take_slip(boat)
    }
}

static LANTERN_{K}: &str = "it's {S}";

''', '''pub fn launch_{K}_{I}(n: u32) -> u32 {
    let m = tow_out(n) + tide::read(n);
    m + {I} /* hold /* fn no() { */ on( */
}

'''),
    Shape(".js", "javascript", '''import part from "../d{D}/part_{N}.js";

/* Rings {S} bells. */
export default function ring{K}(bell) {
  return new Bell(bell).strike({S});
}

export const fog{K} = (horn) => {
  soundHorn(horn);
};

''', '''function knot{K}_{I}(speed) {
  readLog(speed);
  return "no call(" + `nor ${speed}`;
}

const hitch{K}_{I} = /["'`{(]\\/[/}]/g;
let splice{K}_{I} = `${[1].map((r) => `${coilUp{I}(r)} }`).length / 2} {`;
export const Flag{K}_{I} = ({ tint }) => (
  <b title="{(" onClick={() => hoist{I}(tint)}>don't call( {`${waveAt{I}(tint)}`} <br/></b>
);

'''),
)


def code_files(part: DataFrame) -> DataFrame:
    """``path`` and ``source`` for rows with p_partkey and p_size."""
    key, kind = F.col("p_partkey"), (F.col("p_partkey") % len(SHAPES) + 1).cast("int")
    following = key + len(SHAPES)

    def of(field: str) -> Column:
        return F.element_at(F.array(*(F.lit(getattr(s, field)) for s in SHAPES)), kind)

    blocks = F.array_join(F.transform(F.slice(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), 1, F.col("p_size") % BLOCKS), lambda i: F.replace(of("block"), F.lit("{I}"), i.cast("string"))), "")
    text = F.concat(of("head"), blocks)
    for mark, value in (("{K}", key), ("{N}", following), ("{D}", following % DIRS), ("{S}", F.col("p_size"))):
        text = F.replace(text, F.lit(mark), value.cast("string"))
    path = F.concat(F.lit("d"), (key % DIRS).cast("string"), F.lit("/part_"), key.cast("string"), of("ending"))
    return part.select(path.alias("path"), text.alias("source"))
