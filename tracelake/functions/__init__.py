"""Part of tracelake; see the modules."""
