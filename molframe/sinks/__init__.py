"""Writers: topology and coordinate files, bundles with a manifest."""
