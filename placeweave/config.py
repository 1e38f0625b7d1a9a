"""Options of the resolution pipelines."""

from __future__ import annotations

from dataclasses import dataclass

# Statuses of a pair; their order is that of the numbers.
NON_DUPLICATE, NEEDS_REVIEW, LIKELY_DUPLICATE, EXACT_DUPLICATE = 0, 1, 2, 3
CLASS_NAMES = {EXACT_DUPLICATE: "exact_dupe", LIKELY_DUPLICATE: "likely_dupe", NEEDS_REVIEW: "needs_review"}


@dataclass(frozen=True)
class DedupeConfig:
    """One field per option; :meth:`from_args` reads the same options from a command line.

    ``pairing`` is ``all`` (every pair of a block) or ``star`` (each against the block's least uid, then those left over);
    ``star`` only fits the address mode, since names are compared on the pairs that it leaves."""

    address_only: bool = False
    name_only: bool = False
    address_only_candidates: bool = False
    geocode: bool = False
    dupes_only: bool = False
    use_latlon: bool = True
    use_city: bool = False
    use_small_containing: bool = False
    use_postal_code: bool = False
    use_zip5: bool = False
    use_phone_numbers: bool = True
    fuzzy_street_names: bool = True
    with_unit: bool = False
    index_type: str = "info_gain"
    geo_model: bool = True
    geo_model_proportion: float = 0.6
    name_dupe_threshold: float = 0.9
    name_review_threshold: float = 0.7
    geohash_precision: int | None = None
    model_precision: int = 4
    min_tile_docs: int = 1000
    min_word_docs: int = 1
    pairing: str = "all"

    @property
    def block_precision(self) -> int:
        return self.geohash_precision or (7 if self.address_only else 6)

    @classmethod
    def from_args(cls, argv: list[str]) -> tuple[DedupeConfig, list[str], str]:
        """``config, input files, output folder`` of a command line."""
        import argparse

        p = argparse.ArgumentParser(prog="placeweave")
        p.add_argument("files", nargs="+")
        p.add_argument("-o", "--output-dir", required=True)
        for flag in ("address-only", "geocode", "name-only", "address-only-candidates", "dupes-only", "use-city", "use-small-containing", "use-postal-code", "use-zip5", "with-unit"):
            p.add_argument(f"--{flag}", action="store_true")
        for flag, field in (("no-latlon", "use_latlon"), ("no-phone-numbers", "use_phone_numbers"), ("no-fuzzy-street-names", "fuzzy_street_names"), ("no-geo-model", "geo_model")):
            p.add_argument(f"--{flag}", dest=field, action="store_false")
        p.add_argument("--index-type", choices=["tfidf", "info_gain"], default="info_gain")
        p.add_argument("--geo-model-proportion", type=float, default=0.6)
        p.add_argument("--name-dupe-threshold", type=float, default=0.9)
        p.add_argument("--name-review-threshold", type=float, default=0.7)
        a = vars(p.parse_args(argv))
        files, out = a.pop("files"), a.pop("output_dir")
        return cls(**a), files, out
