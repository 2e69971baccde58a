"""Writers: staging, publish and their evidence."""
