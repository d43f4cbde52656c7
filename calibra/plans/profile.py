"""Parameter profiles: the study's own cuts, and cuts that suit the driver tables.

The operators take every threshold as an argument; a profile is just a named
bundle of them. The driver-table values are chosen so that each class and zone
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Profile:
    value_cuts: tuple = (25.0, 75.0)          # class by row value (right-closed bins)
    site_cuts: tuple = (25.0, 75.0)           # class by site mean
    flag_cuts: tuple = (50.0, 500.0, 1000.0)  # agreement flag: ref, s2, s3 upper bounds
    zone_cuts: tuple = (500.0, 1000.0)        # reliable zone: s2, s3 upper bounds
    rmse_cuts: tuple = (35.0, 40.0)          # metric band, lower is better
    r2_cuts: tuple = (0.6, 0.4)              # metric band, higher is better
    test_frac: float = 0.3
    k: int = 5
    seed: int = 42


# The study's thresholds.
STUDY = Profile()

# Cuts for the driver's lineitem/part observation view.
DRIVER = Profile(value_cuts=(20.0, 40.0), site_cuts=(28.9, 29.3), flag_cuts=(25.0, 250.0, 500.0),
                 zone_cuts=(400.0, 800.0), rmse_cuts=(4.8, 4.93), r2_cuts=(0.885, 0.875))
