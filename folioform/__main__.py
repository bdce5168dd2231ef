from .api import main

raise SystemExit(main())
