"""Fluxes and magnitudes of the AB system (fluxes in erg / s / cm^2 / Hz)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Zero point of the AB magnitude, as published.
AB_ZERO = 48.6


def flux_to_ab_mag(flux: Column) -> Column:
    """AB magnitude of a flux; null where it is not positive."""
    return F.when(flux > 0, -2.5 * F.log10(flux) - AB_ZERO)


def ab_mag_to_flux(mag: Column) -> Column:
    return F.pow(F.lit(10.0), -0.4 * (mag + AB_ZERO))


def flux_to_ab_mag_sigma(flux: Column, sigma: Column) -> Column:
    """First-order error of the magnitude."""
    return F.when(flux > 0, F.abs(sigma) / flux * 1.0857362047581296)


def ab_mag_to_flux_sigma(mag: Column, sigma: Column) -> Column:
    return ab_mag_to_flux(mag) * F.abs(sigma) * 0.9210340371976183


def nanojansky_to_ab_mag(flux: Column) -> Column:
    """AB magnitude of a calibrated flux in nanojansky."""
    return F.when(flux > 0, -2.5 * F.log10(flux) + 31.4)


def ab_mag_to_nanojansky(mag: Column) -> Column:
    return F.pow(F.lit(10.0), -0.4 * (mag - 31.4))
