"""Contracts: which variables two models exchange, in what units, as which linear combinations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import units

# Flags of a variable: the grid it lives on, and whether it is initial or private.
GRID_ATMOSPHERE, GRID_ELEVATION, GRID_ICE, INITIAL, PRIVATE = 1, 2, 4, 8, 16
FLAG_NAMES = {GRID_ATMOSPHERE: "ATMOSPHERE", GRID_ELEVATION: "ELEVATION", GRID_ICE: "ICE", INITIAL: "INITIAL", PRIVATE: "PRIVATE"}
UNIT = "UNIT"  # the pseudo-input that is always 1


@dataclass(frozen=True)
class Var:
    """A variable; what is handed on is ``mm * value + bb``."""

    name: str
    units: str = ""
    flags: int = 0
    mm: float = 1.0
    bb: float = 0.0
    default: float | None = None
    description: str = ""


def flag_text(flags: int) -> str:
    return "|".join(n for f, n in FLAG_NAMES.items() if flags & f)


@dataclass
class VarSet:
    """Ordered variables with unique names."""

    vars: list[Var] = field(default_factory=list)

    def add(self, *args, **kw) -> VarSet:
        v = args[0] if args and isinstance(args[0], Var) else Var(*args, **kw)
        if v.name in self.names:
            raise ValueError(f"variable {v.name} is declared twice")
        self.vars.append(v)
        return self

    @property
    def names(self) -> list[str]:
        return [v.name for v in self.vars]

    def __getitem__(self, name: str) -> Var:
        return self.vars[self.names.index(name)]

    def where(self, flags: int, mask: int | None = None) -> list[Var]:
        """Variables with ``flags & mask == flags``."""
        return [v for v in self.vars if v.flags & (flags if mask is None else mask) == flags]

    def schema(self, *keys: tuple[str, str]) -> T.StructType:
        """The table of these variables behind key columns, units in the fields' metadata."""
        out = T.StructType([T.StructField(n, T.StructType.fromDDL(f"x {t}")[0].dataType) for n, t in keys])
        for v in self.vars:
            out = out.add(T.StructField(v.name, T.DoubleType(), True, {"units": v.units, "description": v.description, "flags": v.flags}))
        return out

    def table(self, spark) -> DataFrame:
        rows = [(k, v.name, v.units, v.flags, flag_text(v.flags), v.mm, v.bb, v.default, v.description) for k, v in enumerate(self.vars)]
        return spark.createDataFrame(rows, "pos int, name string, units string, flags int, flag_text string, mm double, bb double, default double, description string")

    def rescale(self, df: DataFrame) -> DataFrame:
        """``mm * value + bb`` for each variable of ``df``."""
        return df.withColumns({v.name: units.affine(F.col(v.name), v.mm, v.bb) for v in self.vars if v.name in df.columns})


@dataclass(frozen=True)
class Term:
    """``dst += coef * src``, ``coef`` a number or the name of a scalar of the step, such as ``by_dt``.

    A number without units is one in the source's own, which are converted; one with
    ``units`` already makes the target's of them.
    """

    dst: str
    src: str
    coef: float | str = 1.0
    units: str = ""


class Transformer:
    """Outputs of one model as linear combinations of another's, units converted."""

    def __init__(self, inputs: VarSet, outputs: VarSet, terms: list[Term]) -> None:
        for t in terms:
            if t.dst not in outputs.names or t.src != UNIT and t.src not in inputs.names:
                raise ValueError(f"no such variable: {t}")
        self.inputs, self.outputs, self.terms = inputs, outputs, terms

    def columns(self, scalars: dict[str, float | None] | None = None) -> list[Column]:
        """One expression for each output; a scalar that is None makes its terms null, a missing one raises."""
        scalars = scalars or {}
        out = []
        for v in self.outputs.vars:
            total = None
            for t in (t for t in self.terms if t.dst == v.name):
                coef = scalars[t.coef] if isinstance(t.coef, str) else t.coef
                f = 1.0 if t.src == UNIT or t.units or isinstance(t.coef, str) else units.factor(self.inputs[t.src].units, v.units)
                src = F.lit(1.0) if t.src == UNIT else F.col(t.src)
                part = src * F.lit(None if coef is None else float(coef) * f).cast("double")
                total = part if total is None else total + part
            out.append((F.lit(v.default).cast("double") if total is None else total).alias(v.name))
        return out

    def select(self, df: DataFrame, *keys: str, scalars: dict[str, float | None] | None = None) -> DataFrame:
        return df.select(*keys, *self.columns(scalars))


#: (climate model, ice model) to a function that gives the transformers there and back.
CONTRACTS: dict[tuple[str, str], Callable[[dict[str, float]], tuple[Transformer, Transformer]]] = {}


def contract(gcm: str, ice: str):
    def put(f):
        CONTRACTS[gcm, ice] = f
        return f

    return put


def setup(gcm: str, ice: str, constants: dict[str, float] | None = None) -> tuple[Transformer, Transformer]:
    if (gcm, ice) not in CONTRACTS:
        raise KeyError(f"no contract between {gcm} and {ice}")
    return CONTRACTS[gcm, ice](constants or {})


def constant(constants: dict[str, tuple[float, str]], name: str, to: str) -> float:
    """A physical constant in other units."""
    value, of = constants[name]
    return value * units.factor(of, to)


@contract("climate", "echo")
def _climate_echo(constants: dict[str, float]) -> tuple[Transformer, Transformer]:
    """Surface mass and enthalpy to the ice, their differences and the surface elevation back."""
    out = VarSet().add("massxfer", "kg m-2 s-1", GRID_ELEVATION).add("enthxfer", "W m-2", GRID_ELEVATION).add("deltah", "J m-2", GRID_ELEVATION)
    ice_in = VarSet().add("massxfer", "kg m-2 s-1", GRID_ICE).add("enthxfer", "W m-2", GRID_ICE).add("deltah", "W m-2", GRID_ICE)
    there = Transformer(out, ice_in, [Term("massxfer", "massxfer"), Term("enthxfer", "enthxfer"), Term("deltah", "deltah", "by_dt")])
    ice_out = VarSet().add("elev", "m", GRID_ICE).add("mass", "kg m-2", GRID_ICE).add("enth", "J m-2", GRID_ICE)
    back = VarSet().add("elev", "m", GRID_ELEVATION).add("smb", "kg m-2 s-1", GRID_ELEVATION).add("heat", "W m-2", GRID_ELEVATION)
    return there, Transformer(ice_out, back, [Term("elev", "elev"), Term("smb", "mass", "by_dt"), Term("heat", "enth", "by_dt")])


@dataclass(frozen=True)
class EnthalpyConverter:
    """Specific enthalpy to temperature and water content at the ice surface, where the pressure counts as zero."""

    specific_heat: float = 2009.0  # J kg-1 K-1
    reference: float = 223.15  # K, where the enthalpy is zero
    melting: float = 273.15  # K
    latent_heat: float = 3.34e5  # J kg-1

    @property
    def solid(self) -> float:
        """The enthalpy of ice at its melting point without any water."""
        return self.specific_heat * (self.melting - self.reference)

    @property
    def liquid(self) -> float:
        """The enthalpy of water at the melting point: what the climate model counts from."""
        return self.solid + self.latent_heat

    def temperature(self, enthalpy: Column) -> Column:
        return F.when(enthalpy < self.solid, enthalpy / self.specific_heat + self.reference).otherwise(self.melting)

    def water(self, enthalpy: Column) -> Column:
        return F.when(enthalpy > self.solid, (enthalpy - self.solid) / self.latent_heat).otherwise(0.0)


LAYER = 40.0  # m, the depth of a layer of the ice model


def conductivity(constants: dict[str, tuple[float, str]]) -> float:
    """How much enthalpy difference drives a unit of heat flux between two layers, in kg m-2 s-1, from the climate model's constants."""
    density = constant(constants, "rhoi", "kg m-3")
    heat = constant(constants, "shi", "J kg-1 K-1")
    return constants["stieglitz_8b"][0] * density * density / (heat * LAYER)


def surface_boundary(df: DataFrame, kappa: float, converter: EnthalpyConverter | None = None, use_smb: bool = True) -> DataFrame:
    """The ice model's inputs with ``ice_top_bc_temp`` and ``ice_top_bc_wc``, a boundary that makes the heat flux ``deltah``.

    ``df`` has ``deltah`` (W m-2) and ``ice_top_senth``, the specific enthalpy of the ice
    below. Without ``use_smb`` the boundary is that ice itself, and no mass or
    enthalpy is transferred.
    """
    converter = converter or EnthalpyConverter()
    above = F.col("ice_top_senth") + (F.col("deltah") / kappa if use_smb else F.lit(0.0))
    out = df.withColumns({"ice_top_bc_temp": converter.temperature(above), "ice_top_bc_wc": converter.water(above)})
    return out if use_smb else out.withColumns({c: F.lit(0.0) for c in ("massxfer", "enthxfer") if c in df.columns})


@contract("climate", "pism")
def _climate_pism(constants: dict[str, float]) -> tuple[Transformer, Transformer]:
    """Surface fluxes to the ice, with enthalpies counted from the ice model's zero; its states, sums and elevations back.

    The constant ``enth_to_ice`` moves a specific enthalpy to the ice model's zero; without it
    the liquid enthalpy of EnthalpyConverter does.
    """
    shift = constants.get("enth_to_ice", EnthalpyConverter().liquid)
    out = VarSet().add("massxfer", "kg m-2 s-1", GRID_ELEVATION).add("enthxfer", "W m-2", GRID_ELEVATION).add("deltah", "J m-2", GRID_ELEVATION)
    ice_in = VarSet().add("massxfer", "kg m-2 s-1", GRID_ICE).add("enthxfer", "W m-2", GRID_ICE).add("deltah", "W m-2", GRID_ICE | PRIVATE)
    there = Transformer(out, ice_in, [Term("massxfer", "massxfer"), Term("enthxfer", "enthxfer"), Term("enthxfer", "massxfer", shift, "J kg-1"), Term("deltah", "deltah", "by_dt")])
    ice_out = VarSet().add("elev", "m", GRID_ICE).add("ice_top_senth", "J kg-1", GRID_ICE).add("mass", "kg m-2", GRID_ICE).add("enth", "J m-2", GRID_ICE)
    back = VarSet().add("elev", "m", GRID_ELEVATION).add("senth", "J kg-1", GRID_ELEVATION).add("smb", "kg m-2 s-1", GRID_ELEVATION).add("heat", "W m-2", GRID_ELEVATION)
    terms = [Term("elev", "elev"), Term("senth", "ice_top_senth"), Term("senth", UNIT, -shift), Term("smb", "mass", "by_dt"), Term("heat", "enth", "by_dt")]
    return there, Transformer(ice_out, back, terms)
