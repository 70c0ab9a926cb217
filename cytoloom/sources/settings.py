"""Workflow settings: defaults and validation."""

from __future__ import annotations

from dataclasses import dataclass, field, fields


@dataclass
class Settings:
    """Raises ValueError, naming the setting, if a value cannot be used."""

    phenotyping_method: str = "Species"
    phenotype_identification_file: str | None = None
    images_to_analyze: list = field(default_factory=list)
    partition_slides_into_rois: bool = True
    roi_width: float = 400.0
    roi_overlap: float = 80.0
    phenotypes_to_analyze: list = field(default_factory=list)
    neighbor_radius: float = 40.0
    significance_calculation_method: str = "Poisson (radius)"
    n_neighs: int = 6
    min_num_valid_centers: int = 10
    weight_by_num_valid_centers: bool = False
    log_pval_minimum: float = -25.0
    log_pval_maximum: float = 0.0
    coordinate_units: float = 0.25
    coord_units_are_pixels: bool = True
    microns_per_integer_unit: float = 0.25

    def __post_init__(self):
        number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
        rules = {
            "phenotyping_method": lambda v: v in ("Species", "Marker", "Custom"),
            "images_to_analyze": lambda v: isinstance(v, list), "phenotypes_to_analyze": lambda v: isinstance(v, list),
            "partition_slides_into_rois": lambda v: isinstance(v, bool), "weight_by_num_valid_centers": lambda v: isinstance(v, bool), "coord_units_are_pixels": lambda v: isinstance(v, bool),
            "roi_width": lambda v: number(v) and v > 0, "roi_overlap": lambda v: number(v) and 0 <= v < self.roi_width, "neighbor_radius": lambda v: number(v) and v > 0,
            "significance_calculation_method": lambda v: isinstance(v, str), "n_neighs": lambda v: isinstance(v, int) and v >= 0, "min_num_valid_centers": lambda v: isinstance(v, int) and v >= 1,
            "log_pval_minimum": lambda v: number(v) and v < 0, "log_pval_maximum": lambda v: number(v) and v <= 0,
            "coordinate_units": lambda v: number(v) and v > 0, "microns_per_integer_unit": lambda v: number(v) and v > 0,
        }
        for name, ok in rules.items():
            if not ok(getattr(self, name)):
                raise ValueError(f"{name}: {getattr(self, name)!r}")
        if self.phenotyping_method == "Custom" and not self.phenotype_identification_file:
            raise ValueError("phenotype_identification_file: needed for Custom")

    @classmethod
    def read(cls, path: str) -> Settings:
        """From a YAML file of nested sections; null sections and an empty file leave the defaults."""
        import yaml  # only needed here

        with open(path, encoding="utf-8-sig") as file:
            sections = yaml.safe_load(file) or {}
        if not isinstance(sections, dict) or not all(isinstance(v, dict | None) for v in sections.values()):
            raise ValueError(f"{path}: sections of settings are expected")
        return cls.from_sections(sections)

    @classmethod
    def from_sections(cls, sections: dict) -> Settings:
        """From nested sections, ``phenotyping: {method: ...}`` and the like; unknown settings raise ValueError."""
        flat = {}
        for section, values in sections.items():
            for key, value in (values or {}).items():
                flat["phenotyping_method" if (section, key) == ("phenotyping", "method") else key] = value
        known = {f.name for f in fields(cls)}
        if extra := set(flat) - known:
            raise ValueError(f"unknown settings: {sorted(extra)}")
        return cls(**flat)
