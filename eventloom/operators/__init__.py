"""Operators on event trains, waveforms and labels, as DataFrame compositions."""
