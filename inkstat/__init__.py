"""Document-quality measures, paired evaluation, matching and revision analytics as DataFrame operators."""
