"""The mixture model: empty, singlet and doublet droplets with ambient molecules."""
