"""Readers and writers of spectra and motifs."""
